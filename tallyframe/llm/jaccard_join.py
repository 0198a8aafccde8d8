"""Similarity join of word shingles by signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches a limit. All links are found, up to
what the components need: no pair is verified that earlier links have already put into one component.

1. Equal sets are one node from the start, so copies never meet again.
2. Which sets can link at all: a linked pair of known size differs in at most d shingles. The range of shingle
   hashes is cut into more than d segments, so some segment is equal in both sets, and its sum of hashes is a
   signature they share. Shingles of very many documents (boilerplate) say little, so segments are of the other
   shingles, which differ no more; sets that consist of frequent ones are given segments of all their shingles
   too. Sets of one size class and the next are given the same segments. Per run of documents
   and signature one entry travels, with local edges for the rest, so a signature of a third of all documents is
   as many entries as there are runs. Sets joined by shared signatures form a cluster; only these go on.
3. Each cluster is a signature tree: sets in order of size, nodes with the OR of their token bitmaps and their
   range of sizes. A dual traversal from the root pair drops node pairs whose largest possible overlap is too
   small for their sizes, and verifies what is left on the sets themselves.
4. Sets of a cluster of more than ``BLOCK`` sets meet by posting: only sets that share a signature
   are compared, however far the cluster reaches by way of others. First every posting's smallest set is verified
   against the others; then, in postings whose sets are still of several components, the most typical sets; then
   all pairs of different components that are left. The last two go by trees of bitmaps alone, whose survivors
   are verified on the sets. A cluster of fewer sets but more than ``TASK_BYTES`` goes by bitmaps alone, in a tree per
   size class instead of per posting. A posting of more than ``BLOCK`` sets is cut into blocks, which the sets outside its
   largest component meet one by one. No task holds more than two blocks or a batch of ``TASK_BYTES``, pairs of one
   component are not verified, and nothing is left out.

Missing texts, and texts without words, have an empty set and link with nothing; with fewer words than a shingle
the whole sequence is the one shingle; repeated rows are equal sets and get a row each; an empty table gives an
empty result. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.components import components
from tallyframe.llm.tables import free_name, map_texts
from tallyframe.llm.text_arrays import Texts, chunks, mix, window_hashes, words_of
from tallyframe.session import release_staged, stage

#: Sets in one tree, entries in one group of signatures, bytes of shingles in one task of small clusters.
BLOCK, GROUP_ENTRIES, TASK_BYTES = 4096, 1_000_000, 16 << 20
#: Share of the distinct sets (of a run, and half of it of all) that makes a shingle frequent; at most the mean
#: size of a set times two over this share are. Which shingles count as frequent changes costs, never results.
FREQUENT, RUN_SHINGLES = 0.002, 1_000_000
_SIX = np.uint64((1 << 48) - 1)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin."""
    words = words_of(texts)
    n = np.diff(words.bounds)
    whole = window_hashes(words.hash, width)
    inside = words.doc[:len(whole)] == words.doc[width - 1:]
    h, doc = whole[inside], words.doc[:len(whole)][inside]
    few = np.flatnonzero((n > 0) & (n < width))
    short = [mix(window_hashes(words.hash[words.bounds[d]:words.bounds[d + 1]], int(n[d])) + np.uint64(n[d])) for d in few]
    if short:
        h, doc = np.concatenate([h, *short]), np.concatenate([doc, few])
    # one sort by text and hash: the text's number replaces nothing, it is the major key
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.searchsorted(doc[first], np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash per set; equal sets have equal keys."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)) >> np.uint64(1)


class SizeClasses:
    """Classes of set sizes such that linked sets are of one class or of neighbours, with the segments of each."""

    def __init__(self, percent: int):
        self.percent, self.begin = percent, [1, 2]

    def _grow(self, size: int) -> None:
        while self.begin[-1] <= size:
            self.begin.append(max(self.begin[-1] + 1, (self.begin[-1] - 1) * 100 // self.percent + 1))

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.begin, size, side="right")) - 1

    def segments(self, k: int) -> int:
        """Segments of the pairs whose smaller set is of class k; none if such a pair could not differ."""
        self._grow(self.begin[min(k, len(self.begin) - 1)])
        differ = (self.begin[k + 1] - 1) * (100 - self.percent) // self.percent
        return differ + 1 + self.spare(k) if differ else 0

    def spare(self, k: int) -> int:
        """Segments more than a pair of class k needs. A linked pair shares one segment more than these, so some
        shared segment is not empty wherever a set has no more empty segments than this."""
        return 4 + (self.begin[k + 1] - 1) * (100 - self.percent) // self.percent // 8


def _segments(h: np.ndarray, m: int, name: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and sizes of the segments of a sorted set."""
    edge = (np.arange(1, m, dtype=np.float64) * (2.0 ** 64 / m)).astype(np.uint64)
    bounds = np.concatenate([[0], np.searchsorted(h, edge), [len(h)]])
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    size = np.diff(bounds)
    names = mix(np.arange(m, dtype=np.uint64) + np.uint64(name << 32))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64) * np.uint64(7) + names), size


def signatures(h: np.ndarray, rare: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Signatures of one sorted set with the given rare shingles, for the pairs of its class and for those of the
    class below. Of two linked sets one has few empty segments of rare shingles, and then shares one that is not
    empty; or both have many, and then all their shingles are cut too, where empty segments count if there are
    many of them as well."""
    k = classes.of(len(h))
    out = []
    for space in (k - 1, k):
        m = classes.segments(space) if space >= 0 else 0
        if not m:
            continue
        sig, size = _segments(rare, m, 2 * space)
        out.append(sig[size > 0])
        if (size == 0).sum() > classes.spare(space):
            sig, size = _segments(h, m, 2 * space + 1)
            out.append(sig if (size == 0).sum() > classes.spare(space) else sig[size > 0])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _members(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, key`` of every document, and rows with a ``shingle`` that is frequent in a run of
    documents, in ``sets`` distinct sets of it; a last row of a run has only the number of all its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, pa.int64())) for c in names], names=names)

        def frequent(held: dict) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = n >= max(3, FREQUENT * len(held))
            return rows(shingle=pa.array([*h[often].view(np.int64), None], pa.int64()),
                        sets=pa.array([*n[often], len(held)], pa.int64()))

        names = ["doc_id", "text_key", "n_shingles", "key", "shingle", "sets"]
        held, size = {}, 0
        for batch in batches:
            for texts in chunks(batch.column("text")):
                h, bounds = shingle_sets(texts, width)
                n, keys = np.diff(bounds), set_keys(h, bounds).astype(np.int64)
                own = batch.slice(texts.first, len(texts))
                yield rows(doc_id=own.column("doc_id"), text_key=own.column("text_key"), n_shingles=pa.array(n, pa.int64()),
                           key=pa.array(keys, pa.int64(), mask=n == 0))
                for d in np.flatnonzero(n):
                    if keys[d] not in held:
                        held[keys[d]] = h[bounds[d]:bounds[d + 1]]
                        size += int(n[d])
                if size >= RUN_SHINGLES:
                    yield frequent(held)
                    held, size = {}, 0
        if held:
            yield frequent(held)

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, key long, shingle long, sets long")


def _frequent(members: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles: those that runs in which they are frequent count often enough."""
    total = members.filter("sets is not null and shingle is null").agg(F.sum("sets")).first()[0] or 0
    often = members.filter("shingle is not null").groupBy("shingle").agg(F.sum("sets").alias("sets")).filter(
        F.col("sets") >= total * FREQUENT / 2).select("shingle").toArrow()
    return np.sort(often.column("shingle").to_numpy().view(np.uint64))


def _packed(values: np.ndarray) -> bytes:
    """48-bit values as planes of bytes, which compress where values are sorted."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked(value: bytes) -> np.ndarray:
    out = np.zeros((len(value) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(value, dtype=np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per signature its smallest key, and edges from that key to the others, as pairs of keys."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = sig[1:] != sig[:-1]
    centre = key[np.flatnonzero(first)][np.cumsum(first) - 1] if len(sig) else key
    edges = np.unique(np.column_stack([centre, key])[centre != key], axis=0)
    return sig[first], key[first], edges


def _shared_signatures(docs: DataFrame, width: int, percent: int, entries: int, frequent: np.ndarray) -> DataFrame:
    """Edges ``a, b`` (48-bit keys) between sets that share a signature: a star around the smallest."""
    bits = max(0, int(np.ceil(np.log2(max(entries / GROUP_ENTRIES, 1)))))

    def rows_of(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig, key, edges = _stars(sig, key)
        cut = np.searchsorted(sig >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(sig)]
        dealt = mix(edges[:, 0] + edges[:, 1] * np.uint64(3)) & np.uint64((1 << bits) - 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(1 << bits), pa.int32()),
            pa.array([_packed(sig[a:b] & _SIX) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            pa.array([_packed(key[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            pa.array([edges[dealt == part].tobytes() for part in range(1 << bits)], pa.binary())], names=["part", "sigs", "keys", "edges"])

    def entries_of(batches):
        classes, held, sigs, keys = SizeClasses(percent), 0, [], []
        for batch in batches:
            for texts in chunks(batch.column("text")):
                h, bounds = shingle_sets(texts, width)
                own = set_keys(h, bounds) & _SIX
                place = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
                rare = frequent[place] != h if len(frequent) else np.ones(len(h), dtype=bool)
                for d in np.flatnonzero(np.diff(bounds)):
                    one = h[bounds[d]:bounds[d + 1]]
                    s = signatures(one, one[rare[bounds[d]:bounds[d + 1]]], classes)
                    sigs.append(s)
                    keys.append(np.full(len(s), own[d]))
                    held += len(s)
                if held >= GROUP_ENTRIES:
                    yield from rows_of(np.concatenate(sigs), np.concatenate(keys))
                    held, sigs, keys = 0, [], []
        if held:
            yield from rows_of(np.concatenate(sigs), np.concatenate(keys))

    def meet(key, table):
        columns = [table.column(c).to_pylist() for c in ("sigs", "keys", "edges")]
        _, _, edges = _stars(np.concatenate([_unpacked(x) for x in columns[0]]), np.concatenate([_unpacked(x) for x in columns[1]]))
        local = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in columns[2] if x]
        edges = np.concatenate([edges, *local]).astype(np.int64)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    packed = docs.select("text").mapInArrow(entries_of, "part int, sigs binary, keys binary, edges binary")
    return packed.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


class Tree:
    """Sets in order of size; level 0 are the sets, every level above has the ORs and ranges of ``FAN`` nodes."""

    FAN, BITS = 16, 2048

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        size = np.array([len(s) for s in self.sets])
        bits = np.zeros((len(sets), self.BITS // 64), dtype=np.uint64)
        for row, s in zip(bits, self.sets):
            place = (s >> np.uint64(20)) % np.uint64(self.BITS)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        lost = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            below, low, high, lost = self.levels[-1]
            at = np.arange(0, len(below), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(below, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][0])))


def _candidates(one: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of sets (places in the trees) that no bound rules out, with their largest overlap."""
    stack = [(len(one.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        a, b = (one.children(level, k) if level else np.array([k]) for k in (i, j))
        below = max(level - 1, 0)
        la = lb = one.levels[below]
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        x, y = x[x <= y], y[x <= y]
        if below == 0:
            x, y = x[x < y], y[x < y]
        # sizes: the smaller of a pair has at least the limit's share of the larger
        fits = (la[2][x] * 100 >= lb[1][y] * percent) & (lb[2][y] * 100 >= la[1][x] * percent)
        x, y = x[fits], y[fits]
        if not len(x):
            continue
        p, q = la[0][x], lb[0][y]
        if below == 0:
            most = np.minimum(la[1][x] - np.bitwise_count(p & ~q).sum(axis=1), lb[1][y] - np.bitwise_count(q & ~p).sum(axis=1))
        else:
            most = np.bitwise_count(p & q).sum(axis=1) + np.minimum(la[3][x], lb[3][y])
        fits = most.astype(np.int64) * (100 + percent) >= (la[1][x] + lb[1][y]) * percent
        x, y, most = x[fits], y[fits], most[fits]
        if below == 0:
            if len(x):
                yield x, y, most
        else:
            stack += [(below, int(u), int(v)) for u, v in zip(x, y)]


def _links(one: Tree, percent: int, names: list) -> list[tuple]:
    """Verified links between names of different components."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []

    def join(a: int, b: int, overlap: int) -> None:
        u, v = names[one.order[a]], names[one.order[b]]
        if overlap * (100 + percent) >= percent * (len(one.sets[a]) + len(one.sets[b])) and root(u) != root(v):
            parent[max(root(u), root(v))] = min(root(u), root(v))
            links.append((u, v))

    if len(one.sets) > Tree.FAN:
        # the most typical sets against all others first: near copies of one text are joined at once
        bits = one.levels[0][0]
        often = np.unpackbits(bits.view(np.uint8), axis=1).mean(axis=0) > 0.5
        typical = (2 * np.unpackbits(bits.view(np.uint8), axis=1)[:, often].sum(axis=1) - one.levels[0][1])
        everything = np.concatenate(one.sets)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in one.sets])])
        for hub in np.argsort(-typical.astype(np.int64), kind="stable")[:3]:
            hit = np.concatenate([[0], np.cumsum(np.isin(everything, one.sets[hub]))])
            for b, overlap in enumerate((hit[bounds[1:]] - hit[bounds[:-1]]).tolist()):
                if b != hub:
                    join(int(hub), b, overlap)
    for x, y, most in _candidates(one, percent):
        for k in np.argsort(-most, kind="stable").tolist():
            a, b = int(x[k]), int(y[k])
            u, v = names[one.order[a]], names[one.order[b]]
            if u != v and root(u) != root(v):
                join(a, b, len(np.intersect1d(one.sets[a], one.sets[b], assume_unique=True)))
    return links


def _traverse(sets: DataFrame, percent: int) -> DataFrame:
    """Links within every ``(task, tree)`` of ``sets``."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for tree, name, value in zip(*[table.column(c).to_pylist() for c in ("tree", "key", "shingles")]):
            rows.setdefault(tree, []).append((name, np.frombuffer(value, dtype=np.uint64)))
        links = [pair for own in rows.values() if len(own) > 1 for pair in _links(Tree([s for _, s in own]), percent, [k for k, _ in own])]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return sets.groupBy("task").applyInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cluster, key, shingles`` of the sets in ``wanted`` (cluster, key, and id and text key of one document that has
    the set; its id may be missing)."""
    wanted = wanted.select("cluster", "key", F.col("doc_id").alias("of"), F.col("text_key").alias("of_text"))
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_text"))).select(
        "cluster", "key", "text")

    def one(batch: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        h, bounds = shingle_sets(texts, width)
        # only the wanted set counts, should two texts have one key
        right = set_keys(h, bounds).astype(np.int64) == batch.column("key").to_numpy()
        packed = [h[a:b].tobytes() if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], right)]
        return {"cluster": batch.column("cluster"), "key": batch.column("key"), "shingles": pa.array(packed, pa.binary())}

    return map_texts(rows, "cluster long, key long, shingles binary", one).filter(F.col("shingles").isNotNull()).dropDuplicates(["key"])


def _tree_links(sets: DataFrame, edges: DataFrame, frequent: np.ndarray, percent: int, block: int) -> DataFrame:
    """Links that connect the components of all clusters."""
    clusters = stage(sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes")))
    is_small = (F.col("n") <= block) & (F.col("bytes") <= TASK_BYTES)
    small = clusters.filter(is_small).agg(F.sum("bytes")).first()[0] or 0
    tasks = int(small // TASK_BYTES) + 1
    of = clusters.select(F.col("cluster").alias("c"), is_small.alias("small"))
    rows = sets.join(of, sets["cluster"] == of["c"]).drop("c")
    whole = rows.filter("small").select(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.col("cluster").alias("tree"), "key", "shingles")
    links = stage(_traverse(whole, percent))
    large = stage(rows.filter("not small").select("cluster", "key", "shingles"))
    release_staged(clusters)
    if large.isEmpty():
        return links
    return links.union(_posting_links(large, edges, frequent, percent, block))


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Bits of a set, four to eight per shingle."""
    bits = 1 << max(9, int(len(h) * 4 - 1).bit_length())
    place = np.zeros(bits, dtype=np.uint8)
    place[((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(place, bitorder="little").view(np.uint64)


def _folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width: halves of wider ones are put on top of each other."""
    least = min(len(b) for b in bitmaps)
    return np.stack([np.bitwise_or.reduce(b.reshape(-1, least), axis=0) for b in bitmaps])


def _sketches(large: DataFrame) -> DataFrame:
    """``key, n, bits`` of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                own = batch.slice(i, 256)
                sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in own.column("shingles")]
                yield pa.RecordBatch.from_arrays([own.column("key"), pa.array([len(h) for h in sets], pa.int32()),
                                                  pa.array([_bitmap(h).tobytes() for h in sets], pa.binary())], names=["key", "n", "bits"])

    return large.mapInArrow(run, "key long, n int, bits binary")


def _postings(large: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """``sig, key``: the signatures of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in batches:
            for i in range(0, len(batch), 256):
                sigs, keys = [], []
                for key, value in zip(batch.column("key").slice(i, 256).to_pylist(), batch.column("shingles").slice(i, 256)):
                    h = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                    place = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
                    own = signatures(h, h[frequent[place] != h] if len(frequent) else h, classes)
                    sigs.append(np.unique(own))
                    keys.append(np.full(len(sigs[-1]), key, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))],
                                                 names=["sig", "key"])

    return large.mapInArrow(run, "sig long, key long")


def _verified(pairs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (hub, key): a hub's set goes once to every batch of about ``TASK_BYTES`` of partners.
    Batches are dealt out by sizes alone, so that a partner's set moves once per pair."""
    size = large.select(F.col("key").alias("k"), F.length("shingles").alias("bytes"))
    heavy = pairs.join(size, F.col("key") == F.col("k")).groupBy(F.col("hub").alias("h")).agg(F.sum("bytes").alias("bytes"))
    weight = stage(heavy.select("h", F.ceil(F.col("bytes") / (TASK_BYTES // 4)).cast("int").alias("batches"), "bytes"))
    tasks = int((weight.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES) + 1
    hubs = weight.select(F.col("h").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), F.lit(0).alias("side"),
                         F.col("h").alias("k"))
    members = pairs.join(weight, F.col("hub") == F.col("h")).select(
        "hub", F.pmod(F.xxhash64("key"), F.col("batches")).cast("int").alias("batch"), F.lit(1).alias("side"), F.col("key").alias("k"))
    rows = hubs.unionByName(members).join(large, F.col("k") == F.col("key")).drop("k")

    def run(table: pa.Table) -> pa.Table:
        at: dict[tuple, int] = {}
        partners: dict[tuple, list[int]] = {}
        for i, (hub, batch, side) in enumerate(zip(*[table.column(c).to_pylist() for c in ("hub", "batch", "side")])):
            if side:
                partners.setdefault((hub, batch), []).append(i)
            else:
                at[hub, batch] = i
        values, links = table.column("shingles"), []
        for (hub, batch), others in partners.items():
            one = np.frombuffer(values[at[hub, batch]].as_buffer(), dtype=np.uint64)
            for i in others:
                other = np.frombuffer(values[i].as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both * (100 + percent) >= percent * (len(one) + len(other)):
                    links.append((hub, table.column("key")[i].as_py()))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    task = F.pmod(F.xxhash64("hub", "batch"), F.lit(tasks))
    found = stage(rows.withColumn("task", task).groupBy("task").applyInArrow(run, "a long, b long"))
    release_staged(weight)
    return found


def _open_postings(postings: DataFrame, clusters: DataFrame, component: DataFrame) -> DataFrame:
    """``sig, key, component, n, low, high, largest, others`` of postings whose sets are of several components. Each has a
    set outside its cluster's largest component, so only the signatures of such sets are looked at."""
    known = stage(clusters.join(component, F.col("key") == F.col("node"), "left").select(
        "cluster", F.col("key").alias("k"), F.coalesce("component", "key").alias("component")))
    largest = known.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy(F.col("cluster").alias("c")).agg(
        F.max_by("component", F.struct("n", "component")).alias("most"))
    minor = stage(known.join(largest, F.col("cluster") == F.col("c")).filter("component <> most").select(F.col("k").alias("minor")))
    sigs = stage(postings.join(minor, F.col("key") == F.col("minor")).select(F.col("sig").alias("s")).distinct())
    members = postings.join(sigs, F.col("sig") == F.col("s")).join(known, F.col("key") == F.col("k")).select("sig", "key", "component")
    members = stage(members)
    parts = members.groupBy("sig", "component").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    several = parts.groupBy(F.col("sig").alias("s")).agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("others"))
    several = stage(several.filter("parts > 1").drop("parts"))
    out = stage(members.join(several, F.col("sig") == F.col("s")).drop("s"))
    for done in (known, minor, sigs, members, several):
        release_staged(done)
    return out


def _placed(members: DataFrame, every: bool, block: int) -> DataFrame:
    """``tree, side, key, component``. A posting of up to ``block`` sets is one tree; a larger one is cut into blocks. To
    find hubs, its first and last sets are in all blocks; to find every pair, the sets outside its largest component
    meet each block, in parts of bounded size."""
    some = members.filter(F.col("n") <= block).select(F.col("sig").alias("tree"), F.lit(0).alias("side"), "key", "component")
    hot = members.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    tree = F.xxhash64("sig", "block", "part")
    if not every:
        at = F.when((F.col("key") == F.col("low")) | (F.col("key") == F.col("high")), all_blocks).otherwise(F.array(own))
        cut = hot.withColumn("block", F.explode(at)).withColumn("part", F.lit(0))
        return some.unionByName(cut.select(tree.alias("tree"), F.lit(0).alias("side"), "key", "component"))
    parts = F.greatest(F.ceil(F.col("others") / block).cast("int"), F.lit(1))
    hot = hot.withColumn("parts", parts)
    base = hot.withColumn("block", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = hot.filter("component <> largest").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")).withColumn(
        "block", F.explode(all_blocks))
    return some.unionByName(base.select(tree.alias("tree"), F.lit(0).alias("side"), "key", "component")).unionByName(
        rest.select(tree.alias("tree"), F.lit(1).alias("side"), "key", "component"))


class Bounds:
    """A signature tree of bitmaps alone; sets of one component are next to each other, so that an OR says something.
    Leaf pairs that the bounds leave over are candidates; those within one component are passed over."""

    FAN = 8

    def __init__(self, bits: np.ndarray, size: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((size, component))
        bits, size, component = bits[self.order], size[self.order], component[self.order]
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(axis=1), component, component)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, lost, first, last = self.levels[-1]
            at = np.arange(0, len(bits), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(lost, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _bounded_pairs(one: Bounds, other: Bounds, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal, level by level: places (in the given order) of pairs of different components that can link."""
    same, depth = one is other, max(len(one.levels), len(other.levels)) - 1
    x = y = np.zeros(min(len(one.order), len(other.order), 1), dtype=np.int64)
    for level in range(depth, -1, -1):
        la, lb = one.levels[min(level, len(one.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
        if level < depth:
            x, y = _children(x, y, level, one, other)
        if same:
            keep = x < y if level == 0 else x <= y
            x, y = x[keep], y[keep]
        parts = []
        # a bounded number of node pairs at a time
        for i in range(0, len(x), 1 << 14):
            u, v = x[i:i + (1 << 14)], y[i:i + (1 << 14)]
            # one component on both sides
            keep = ~((la[4][u] == la[5][u]) & (lb[4][v] == lb[5][v]) & (la[4][u] == lb[4][v]))
            keep &= (la[2][u] * 100 >= lb[1][v] * percent) & (lb[2][v] * 100 >= la[1][u] * percent)
            u, v = u[keep], v[keep]
            p, q = la[0][u], lb[0][v]
            if level == 0:
                most = np.minimum(la[1][u] - np.bitwise_count(p & ~q).sum(axis=1), lb[1][v] - np.bitwise_count(q & ~p).sum(axis=1))
            else:
                most = np.bitwise_count(p & q).sum(axis=1) + np.minimum(la[3][u], lb[3][v])
            keep = most.astype(np.int64) * (100 + percent) >= (la[1][u] + lb[1][v]) * percent
            parts.append((u[keep], v[keep]))
        x, y = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return one.order[x], other.order[y]


def _children(x: np.ndarray, y: np.ndarray, level: int, one: Bounds, other: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children, on this level, of pairs of nodes on the level above."""
    for tree, first in ((one, True), (other, False)):
        if level + 1 < len(tree.levels):
            mine = x if first else y
            width = np.minimum((mine + 1) * Bounds.FAN, len(tree.levels[level][0])) - mine * Bounds.FAN
            child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(mine * Bounds.FAN, width)
            x, y = (child, np.repeat(y, width)) if first else (np.repeat(x, width), child)
    return x, y


def _hub_pairs(bits: np.ndarray, size: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The three most typical sets of a posting with the sets of other components that the bounds allow."""
    often = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    common = often.mean(axis=0) > 0.5
    typical = 2 * often[:, common].sum(axis=1, dtype=np.int64) - size
    x, y = [], []
    for hub in np.argsort(-typical, kind="stable")[:3]:
        most = np.minimum(size[hub] - np.bitwise_count(bits[hub] & ~bits).sum(axis=1), size - np.bitwise_count(bits & ~bits[hub]).sum(axis=1))
        fits = np.flatnonzero((most.astype(np.int64) * (100 + percent) >= (size[hub] + size) * percent) & (component != component[hub]))
        x.append(np.full(len(fits), hub))
        y.append(fits)
    return np.concatenate(x), np.concatenate(y)


def _candidate_pairs(placed: DataFrame, sketches: DataFrame, every: bool, percent: int) -> DataFrame:
    """Distinct ``hub, key`` of pairs in the trees of ``placed`` that bitmaps leave over."""
    rows = placed.join(sketches.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k")
    tasks = int((rows.agg(F.sum(F.length("bits") + 64)).first()[0] or 0) // TASK_BYTES) + 1

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree").to_numpy()
        order = np.argsort(tree, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], tree[order][1:] != tree[order][:-1], [True]]))
        side, key, component, size = (table.column(c).to_numpy() for c in ("side", "key", "component", "n"))
        bits = table.column("bits").combine_chunks()
        a, b = [], []
        for i, j in zip(edges[:-1], edges[1:]):
            mine = order[i:j]
            maps = _folded([np.frombuffer(bits[int(r)].as_buffer(), dtype=np.uint64) for r in mine])
            n, of, which = size[mine].astype(np.int64), component[mine], side[mine]
            if every and which.any():
                left, right = np.flatnonzero(which == 0), np.flatnonzero(which)
                x, y = _bounded_pairs(Bounds(maps[left], n[left], of[left]), Bounds(maps[right], n[right], of[right]), percent)
                x, y = left[x], right[y]
            elif every:
                whole = Bounds(maps, n, of)
                x, y = _bounded_pairs(whole, whole, percent)
            else:
                x, y = _hub_pairs(maps, n, of, percent)
            a.append(key[mine][x])
            b.append(key[mine][y])
        a, b = np.concatenate(a), np.concatenate(b)
        # the hub is the first where hubs were chosen, and the larger key otherwise, one way for each pair
        if every:
            a, b = np.maximum(a, b), np.minimum(a, b)
        pairs = np.unique(np.column_stack([a, b]), axis=0)
        return pa.table({"hub": pa.array(pairs[:, 0], pa.int64()), "key": pa.array(pairs[:, 1], pa.int64())})

    task = F.pmod(F.xxhash64("tree", F.lit(2)), F.lit(tasks))
    return stage(rows.withColumn("task", task).groupBy("task").applyInArrow(run, "hub long, key long").distinct())


def _whole_clusters(few: DataFrame, component: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``tree, side, key, component`` of clusters of few but large sets that are still of several components: a tree for
    the sets of a size class and the next, as linked sets are never further apart."""
    known = few.join(component, F.col("key") == F.col("node"), "left").select(
        "cluster", F.col("key").alias("k"), F.coalesce("component", "key").alias("component"))
    still = known.groupBy(F.col("cluster").alias("c")).agg((F.min("component") < F.max("component")).alias("several")).filter("several")
    sized = known.join(still, F.col("cluster") == F.col("c")).join(sketches.select("key", "n"), F.col("k") == F.col("key"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent)))
    placed = sized.withColumn("class", F.explode(F.array(size_class, size_class - 1)))
    return placed.select(F.xxhash64("cluster", "class").alias("tree"), F.lit(0).alias("side"), "key", "component")


def _posting_links(large: DataFrame, edges: DataFrame, frequent: np.ndarray, percent: int, block: int) -> DataFrame:
    """Links that connect the components of large clusters. Those of few sets are trees of bitmaps whole; the sets of
    others meet by posting: those that share a signature."""
    many = large.groupBy(F.col("cluster").alias("c")).agg((F.count("*") > block).alias("many"))
    clusters = stage(large.select("cluster", "key", F.col("key").bitwiseAND(F.lit(int(_SIX))).alias("short")).join(
        many, F.col("cluster") == F.col("c")).drop("c"))
    sets, sketches = large.select("key", "shingles"), stage(_sketches(large.select("key", "shingles")))
    few, rest = clusters.filter("not many").select("cluster", "key"), clusters.filter("many").select("cluster", "key")
    links, postings = large.sparkSession.createDataFrame([], "a long, b long"), None
    if not rest.isEmpty():
        own = clusters.filter("many")
        one, other = own.select(F.col("key").alias("hub"), F.col("short").alias("a")), own.select("key", F.col("short").alias("b"))
        links = _verified(stage(edges.join(one, "a").join(other, "b").filter("hub <> key").select("hub", "key").distinct()), sets, percent)
        postings = stage(_postings(sets.join(rest.select(F.col("key").alias("k")), F.col("key") == F.col("k")).drop("k"), frequent, percent))
    for every in (False, True):
        of = components(links)
        placed, members = _whole_clusters(few, of, sketches, percent), None
        if postings is not None:
            members = _open_postings(postings, rest, of)
            placed = placed.unionByName(_placed(members, every, block))
        pairs = _candidate_pairs(placed, sketches, every, percent)
        links = links.union(_verified(pairs, sets, percent))
        if members is not None:
            release_staged(members)
    return links


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _labelled(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_shingles, set``, equal for linked rows and missing without shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    told = stage(_members(rows, width))
    members = told.filter("sets is null").select("doc_id", "text_key", "n_shingles", "key")
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    entries = 2 * shingles * (100 - percent) // percent
    often = _frequent(told)
    edges = stage(_shared_signatures(rows, width, percent, entries, often))
    cluster = components(edges)
    # a document with an id if there is one; sets whose documents have none are fetched by their text alone
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    one_each = members.filter("key is not null").groupBy("key").agg(first).select("key", "first.doc_id", "first.text_key")
    # clusters are of shortened keys; sets whose keys are cut alike are in one cluster, which is harmless
    wanted = one_each.join(cluster, F.col("key").bitwiseAND(F.lit(int(_SIX))) == F.col("node")).select(
        F.col("component").alias("cluster"), "key", "doc_id", "text_key")
    sets = stage(_sets_of(rows, wanted, width))
    of_key = components(_tree_links(sets, edges, often, percent, block))
    release_staged(sets)
    return stage(members.join(of_key, members["key"] == of_key["node"], "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component", "key").alias("set")))


def linked(docs: DataFrame, width: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, the smallest id that links reach (missing if none of
    the linked rows has one)."""
    labelled = _labelled(docs, width, percent, block)
    # staged, so that the join below has two plain sides and a set of very many documents can be split
    lowest = stage(labelled.filter("set is not null").groupBy(F.col("set").alias("of")).agg(F.min("doc_id").alias("component_id")))
    return labelled.join(lowest, F.col("set") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per component: of its smallest id (missing ids last), under that of its smallest text key and,
    of rows with equal ids and texts, of the smallest hash of all columns. Rows without shingles link with nothing and
    all stay."""
    stays, text, number, chosen = (free_name(docs, name) for name in ("__stays", "__text", "__n", "__row"))
    labelled = _labelled(docs, width, percent, BLOCK)
    texts = labelled.filter("set is not null").groupBy("set", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("first")
    lone = labelled.filter("set is null").select("doc_id", "text_key").distinct().withColumn("n", F.lit(1).cast("long"))
    stay = stage(texts.groupBy("set").agg(first).select("first.doc_id", "first.text_key", "first.n").unionByName(lone).select(
        F.col("doc_id").alias(stays), F.col("text_key").alias(text), F.col("n").alias(number)))
    found = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(F.col(stays)) & (_text_key() == F.col(text)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = found.filter(F.col(number) > 1).groupBy(stays, text).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(chosen))
    return found.filter(F.col(number) == 1).select(*docs.columns).unionByName(repeated.select(f"{chosen}.*"))


LINKED_SQL = r"""
with recursive rows as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
texts as (select min(doc_id) as d, w from rows where len(w) > 0 group by w),
shingles as materialized (
  select distinct d, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') || ' ' || least(len(w), 3) as g
  from (select d, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from texts)),
sizes as materialized (select d, count(*) as n from shingles group by d),
common as (select a.d as a, b.d as b, count(*) as n_both from shingles a join shingles b on a.g = b.g and a.d < b.d group by 1, 2),
links as materialized (
  select a, b from common join sizes x on x.d = a join sizes y on y.d = b where 100 * n_both >= 90 * (x.n + y.n - n_both)),
edges as materialized (select a, b from links union all select b, a from links),
reached as (
  select d as d, d as c from sizes
  union
  select e.b as d, reached.c from reached join edges e on e.a = reached.d and reached.c < e.b),
lowest as (select d, min(c) as c from reached group by d)
select rows.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(l.c, rows.doc_id) as component_id
from rows left join texts t on t.w = rows.w left join sizes s on s.d = t.d left join lowest l on l.d = t.d
"""
