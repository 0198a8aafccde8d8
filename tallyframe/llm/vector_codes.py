"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

1. Components become ``floor(1024 x)``; every part position's codebook starts as that part of the vectors with the
   256 smallest ids. Tasks keep their 256 smallest ids, so only those are ordered.
2. Vectors are put together in runs of ``RUN``. Every run's parts become metric trees (``metric_trees``), written to
   the shared folder once; all later passes read them.
3. In each round the codebooks (256 entries, whatever the input) go to all tasks. Tasks go down their trees and
   return one sum per entry and component; a grouped sum gives the new entries, ``floor(sum / count)``. Entries
   without a part stay.
4. Parts are assigned once more; errors are summed per label with map-side combining and joined back.

Nothing else is shuffled, no vector leaves its run, and equal vectors, however many, are a ball of radius 0.

Left out are rows whose vector is missing or has a missing, infinite or undefined component. Shorter vectors count as
ending in zeros, and part i of d components is ``d*i//4 : d*(i+1)//4``. A missing id comes last in the order of ids;
of several vectors with one id the smallest one (component by component, then the shorter) starts an entry. With fewer than 256 ids there are fewer entries. Repeated
rows are coded each; missing labels are one label; ties go to the lower entry. Distances must fit into 64 bits
(components up to about 10**5), beyond that the operator stops with an error. An empty table gives an empty
result, and columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.metric_trees import Tree, anchors_tree, entry_sums, nearest
from tallyframe.llm.tables import rows_of
from tallyframe.session import release_staged, stage

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Vectors of one set of trees.
RUN = 4096

_TREE = "points binary, order binary, begin binary, end binary, left binary, right binary, radius binary, total binary"


def _cuts(width: int) -> list[slice]:
    return [slice(width * i // PARTS, width * (i + 1) // PARTS) for i in range(PARTS)]


def _numbers(batch: pa.RecordBatch, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the batch that are kept, their vectors' sizes, and these as whole numbers, zeros at the end."""
    column = batch.column("vector")
    lists = column.offsets.to_numpy()
    present = np.asarray(column.is_valid())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.flatnonzero(present & (bad[lists[1:]] == bad[lists[:-1]]))
    size = np.diff(lists)[kept]
    out = np.zeros((len(kept), max(width, int(size.max(initial=0)))), dtype=np.float64)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(kept)), size), at] = flat[np.repeat(lists[kept], size) + at]
    out = np.floor(out * SCALE)
    if np.abs(out).max(initial=0) >= 1 << 30:
        raise ValueError("components are too large for squared distances in 64 bits")
    return kept, size, out.astype(np.int64)


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest distinct ids of a task with the smallest vector of each, and the longest vector's size."""
    best: dict[tuple[bool, int], list[int]] = {}
    widest = 0
    for batch in batches:
        kept, size, numbers = _numbers(batch)
        widest = max(widest, numbers.shape[1])
        ids = batch.column("vec_id").take(pa.array(kept))
        key = np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).max, np.asarray(ids.fill_null(0)))
        for i in np.flatnonzero(key <= np.sort(np.unique(key))[:ENTRIES][-1]) if len(key) else []:
            name, vector = (not ids[i].is_valid, ids[i].as_py() or 0), numbers[i, :size[i]].tolist()
            best[name] = min(best.get(name, vector), vector)
        best = dict(sorted(best.items())[:ENTRIES])
    if best or widest:
        yield pa.RecordBatch.from_arrays([
            pa.array([None if missing else v for missing, v in best], pa.int64()),
            pa.array(list(best.values()), pa.list_(pa.int64())), pa.array([widest] * len(best), pa.int64())],
            names=["vec_id", "numbers", "width"])


def _first_entries(vectors: DataFrame) -> tuple[list[np.ndarray], int]:
    """The codebooks' starts and the vectors' size."""
    seeds = stage(vectors.mapInArrow(_smallest, "vec_id long, numbers array<long>, width long"))
    width = seeds.agg(F.max("width")).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("numbers"))
    one = seeds.groupBy("vec_id").agg(F.min("numbers").alias("numbers"))
    rows = one.withColumn("numbers", F.concat("numbers", zeros)).orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()
    release_staged(seeds)
    book = np.array([r.numbers for r in rows], dtype=np.int64).reshape(len(rows), width)
    return [np.ascontiguousarray(book[:, c]) for c in _cuts(width)], width


def _trees(vectors: DataFrame, width: int) -> DataFrame:
    """One row per run: ids, labels and a tree per part."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
            numbers = np.concatenate([n for _, n in held])
            trees = [anchors_tree(np.ascontiguousarray(numbers[:, c])).packed() for c in _cuts(width)]
            own = [pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), table.column(c).combine_chunks())
                   for c in ("vec_id", "label")]
            tree = pa.StructArray.from_arrays([pa.array([t[f] for t in trees], pa.binary()) for f in trees[0]], names=list(trees[0]))
            return pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array([0, PARTS], pa.int32()), tree)],
                                              names=["ids", "labels", "trees"])

        for batch in batches:
            kept, _, numbers = _numbers(batch, width)
            batch = batch.select(["vec_id", "label"]).take(pa.array(kept))
            for i in range(0, len(kept), RUN):
                held.append((batch.slice(i, RUN), numbers[i:i + RUN]))
                rows += len(numbers[i:i + RUN])
                if rows >= RUN:
                    yield packed()
                    held, rows = [], 0
        if rows:
            yield packed()

    return vectors.mapInArrow(run, f"ids array<long>, labels array<{label}>, trees array<struct<{_schema(_TREE)}>>")


def _schema(columns: str) -> str:
    return ", ".join(c.replace(" ", ":") for c in columns.split(", "))


def _opened(row: dict, books: list[np.ndarray]) -> list[Tree]:
    return [Tree.unpacked(t, b.shape[1]) for t, b in zip(row["trees"], books)]


def _sums(books: list[np.ndarray]):
    """One row per part, entry and component: sum and number of the parts of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros(b.shape, dtype=np.int64) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for row in rows_of(batch.select(["trees"])):
                for p, tree in enumerate(_opened(row, books)):
                    total, count = entry_sums(tree, books[p])
                    totals[p] += total
                    counts[p] += count
        for p, (total, count) in enumerate(zip(totals, counts)):
            entry, place = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(entry), p, dtype=np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)),
                pa.array(total[entry, place]), pa.array(count[entry])], names=["part", "entry", "place", "total", "n"])

    return run


def _coded(books: list[np.ndarray], label: str):
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = next(rows_of(batch.slice(i, 1).select(["trees"])))
                found = [nearest(tree, book) for tree, book in zip(_opened(row, books), books)]
                code = hexes[found[0][0]]
                for entry, _ in found[1:]:
                    code = np.char.add(code, hexes[entry])
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(),
                    pa.array(code.tolist(), pa.string()), pa.array(sum(e for _, e in found))],
                    names=["vec_id", "label", "code", "error"])

    return run, f"vec_id long, label {label}, code string, error long"


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` of every kept row of ``vectors`` (vec_id, embedding, label), staged, and the
    final codebooks, one array of entries per part."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label"))
    books, width = _first_entries(vectors.select("vec_id", "vector"))
    label = vectors.schema["label"].dataType.simpleString()
    if not len(books[0]):
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), books
    trees = stage(_trees(vectors, width))
    for _ in range(rounds):
        sums = trees.select("trees").mapInArrow(_sums(books), "part int, entry int, place int, total long, n long")
        books = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    run, schema = _coded(books, label)
    coded = stage(trees.mapInArrow(run, schema))
    release_staged(trees)
    return coded, books


def report(vectors: DataFrame) -> DataFrame:
    """Code and errors of every kept row, with a digest of the final codebooks."""
    coded, books = compress(vectors)
    numbers = ",".join(str(v) for book in books for v in book.ravel().tolist())
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def _report_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL, every part against every entry. Whole numbers are exact in double precision here."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS MATERIALIZED (SELECT coalesce(max(len(v)), 0) AS w FROM kept),
places AS (SELECT p, w * p // 4 AS low, w * (p + 1) // 4 AS high FROM width, range(4) t(p)),
parts AS MATERIALIZED (
  SELECT rid, p, list_resize(v, w, 0)[low + 1:high] AS x FROM kept, width, places),
seeds AS (SELECT vec_id, min(v) AS v FROM kept GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 256),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST) - 1 AS e, list_resize(v, w, 0)[low + 1:high] AS c
  FROM seeds, width, places)"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min({{'d': coalesce(list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))), 0), 'e': e}}) AS best
  FROM parts JOIN book{r} USING (p) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p, e, k, sum(y)::BIGINT AS s, count(*) AS n
  FROM (SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM near{r}) GROUP BY p, e, k),
mean{r} AS (
  SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::DOUBLE ORDER BY k) AS c FROM sums{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))""")
    return "WITH" + ",".join(steps) + f""",
numbers AS (SELECT p, e, unnest(c)::BIGINT AS y, generate_subscripts(c, 1) AS k FROM book{rounds}),
digest AS (SELECT sha256(coalesce(string_agg(y::VARCHAR, ',' ORDER BY p, e, k), '')) AS codebooks_sha256 FROM numbers),
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest"""


REPORT_SQL = _report_sql()
