"""Language-model scoring with Brown's class bigrams.

P(word | previous word) = P(class | previous class) * P(word | class). Classes come from exchange clustering:
a word moves to the class under which the bigrams around it are likeliest.

1. Texts are cut into tokens once, and written as runs: token numbers into a sorted vocabulary of the run's own,
   with training counts. Nothing later reads the texts again.
2. Vocabularies, as packed slices of hash ranges, meet in a grouped sum that answers every run with the corpus
   counts of its words. Only distinct words per run travel, and a word's rows are as many as the runs it is in.
3. Every word with at least ``MIN_COUNT`` training tokens is clustered, so more words are as the corpus grows. Rarer
   words, which give exchange no evidence, keep the class of their frequency (powers of two), and unseen words
   share the class of words seen once. Runs keep a class for each word of theirs.
4. A pass counts, per run, how often each word stands beside each class; the counts of a word's runs meet in a
   grouped table of words by classes, and those of classes by classes are added up. Against the latter, each word of
   all move to their best class, or those of one half (by hash), and the runs are answered. A pass over the runs tells
   whether the likelihood gained; if not, the moves are undone. All words move while that gains, then halves take
   turns, until neither gains.
5. Class transitions and word emissions, smoothed by 0.1, score every document.

The driver holds tables of classes by classes only. Documents whose CRC-32 remainder is 0 are held out of all counts.
Missing and empty texts consist of one end token; repeated rows are counted and scored each; without training
documents all probabilities are those of the smoothing; an empty table gives an empty result. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.tables import doc_remainder, rows_of
from tallyframe.llm.text_arrays import chunks, mix, sums_by, words_of
from tallyframe.session import release_staged, stage, stage_bucketed

REMAINDER = 10
SMOOTH = 0.1
#: Training tokens a clustered word has at least, and classes of clustered words.
MIN_COUNT, CLASSES = 20, 32
#: Moves gain if the log-likelihood rises by more than this share of it.
GAIN = 5e-4
#: Tokens of a run, distinct words (of all runs) that one group of hashes should hold, and bytes of counts in a group.
RUN_TOKENS, GROUP_WORDS, GROUP_BYTES = 500_000, 1_000_000, 32 << 20

_RUNS = "run long, doc_ids array<long>, train array<boolean>, sizes array<int>, stream binary, vocabulary binary, counts binary, words long, trained long, ends long"


def _run(number: int, doc_ids: list, train: list, sizes: list, hashes: list) -> pa.RecordBatch:
    ids, n = np.concatenate(doc_ids) if doc_ids else [], np.concatenate(sizes)
    trained = np.concatenate(train)
    vocabulary, stream = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(stream[np.repeat(trained, n)], minlength=len(vocabulary)).astype(np.int64)
    row = {"run": [number], "doc_ids": [[None if i is None else int(i) for i in ids]], "train": [trained.tolist()],
           "sizes": [n.tolist()], "stream": [_planes(stream)], "vocabulary": [_rising(vocabulary)],
           "counts": [counts.tobytes()], "words": [len(vocabulary)], "trained": [int(n[trained].sum() + trained.sum())],
           "ends": [int(trained.sum())]}
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
             pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))


def token_runs(docs: DataFrame, run_tokens: int = RUN_TOKENS) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_remainder(REMAINDER) != 0).alias("train"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            for texts in chunks(batch.column("text")):
                words = words_of(texts)
                own = batch.slice(texts.first, len(texts))
                for part, x in zip(parts, (np.array(own.column("doc_id").to_pylist(), dtype=object),
                                           np.array(own.column("train").to_pylist(), dtype=bool),
                                           np.diff(words.bounds), words.hash)):
                    part.append(x)
                held += len(words.hash) + len(texts)
                if held >= run_tokens:
                    yield _run(number, *parts)
                    number, held, parts = number + 1, 0, ([], [], [], [])
        if held:
            yield _run(number, *parts)

    return rows.mapInArrow(cut, _RUNS)


def _array(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(value, dtype=kind)


def band(counts: np.ndarray) -> np.ndarray:
    """Frequency class of a count: 0 for none and one, then by powers of two."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct training tokens, documents; words and tokens of the bands of rare words."""

    tokens: int
    distinct: int
    ends: int
    band_words: np.ndarray
    band_tokens: np.ndarray


def _counted(runs: DataFrame, total_words: int, min_count: int) -> DataFrame:
    """Packed answers: for every run and hash group, corpus counts of its slice of the vocabulary. Rows with
    run -1 sum up a group: words and tokens of rare words by band, and of the others by their logarithm (in
    steps of a sixteenth of a power of two)."""
    bits = max(0, int(np.ceil(np.log2(max(total_words / GROUP_WORDS, 1)))))

    def slices(batches):
        for batch in batches:
            for r in rows_of(batch):
                run, v, c = r["run"], _from_rising(r["vocabulary"]), _array(r["counts"], np.int64)
                bounds = np.searchsorted(v >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(v)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(1 << bits), pa.int32()), pa.array([run] * (1 << bits), pa.int64()),
                    pa.array([v[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.array([c[a:b].astype(np.int32 if c.max(initial=0) < 1 << 31 else np.int64).tobytes()
                              for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["part", "run", "vocabulary", "counts"])

    def add_up(key, table):
        vs = [_array(x, np.uint64) for x in table.column("vocabulary").to_pylist()]
        cs = [_array(x, np.int32 if len(x) == 4 * len(v) else np.int64) for x, v in zip(table.column("counts").to_pylist(), vs)]
        words, place = np.unique(np.concatenate(vs), return_inverse=True)
        total = np.bincount(place, np.concatenate(cs).astype(np.float64), len(words)).astype(np.int64)
        ends = np.cumsum([len(v) for v in vs])
        answers = [total[place[e - len(v):e]].tobytes() for v, e in zip(vs, ends)]
        often = total >= min_count
        rest, level = total[(total > 0) & ~often], log_level(total[often])
        sums = [np.bincount(band(rest), minlength=1), np.bincount(band(rest), rest, 1), np.bincount(level, minlength=1),
                np.bincount(level, total[often], 1)]
        return pa.table({
            "run": pa.array([*table.column("run").to_pylist(), -1], pa.int64()),
            "part": pa.array([key[0].as_py()] * (len(vs) + 1), pa.int32()),
            "totals": pa.array([*answers, b""], pa.binary()),
            **{name: pa.array([None] * len(vs) + [x.astype(np.int64).tolist()], pa.list_(pa.int64())) for name, x in zip(_SUMS, sums)}})

    return runs.select("run", "vocabulary", "counts").mapInArrow(
        slices, "part int, run long, vocabulary binary, counts binary").groupBy("part").applyInArrow(
        add_up, "run long, part int, totals binary, " + ", ".join(f"{c} array<long>" for c in _SUMS))


_SUMS = ("band_words", "band_tokens", "level_words", "level_tokens")


def log_level(counts: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _totals(answers: DataFrame, tokens: int, ends: int, bands: int, classes: int) -> tuple[Totals, np.ndarray]:
    """Corpus totals, and where the levels begin and end between 0 and the number of classes when words lie in the order
    of falling counts, each as wide as the square root of its count."""

    def summed(name: str, size: int) -> np.ndarray:
        rows = answers.filter("run = -1").select(F.posexplode(name).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(max([r.i + 1 for r in rows] + [size]), dtype=np.int64)
        for r in rows:
            out[r.i] = r.n
        return out

    words, rare, level_words, mass = (summed(c, n) for c, n in zip(_SUMS, (bands, bands, 1, 1)))
    wide = np.sqrt(mass.astype(np.float64) * level_words)
    until = np.cumsum(wide[::-1])[::-1]
    first = np.stack([until - wide, until]) * classes / max(wide.sum(), 1e-300)
    return Totals(tokens, int(words.sum() + level_words.sum()) + (ends > 0), ends, words, rare), first


_NUMBERED = ("run long, doc_ids array<long>, train array<boolean>, sizes array<int>, numbers binary, words binary, n binary, classes binary, "
             "known array<int>, base array<double>, emitted array<double>")


def _numbered(runs: DataFrame, answers: DataFrame, t: Totals, first: np.ndarray, min_count: int, classes: int) -> DataFrame:
    """Runs of numbers: clustered words of the run by hash, then the bands of rare words; with hash, count and
    first class of the former, and what needs each word's own count already summed."""
    of_run = answers.filter("run >= 0").groupBy(F.col("run").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("totals"))
    joined = runs.select("run", "doc_ids", "train", "sizes", "stream", "vocabulary").join(of_run, F.col("run") == F.col("of")).drop("of")
    below = np.log10(t.tokens + SMOOTH * (t.distinct + 1))

    def one(batches):
        for b in batches:
            for r in rows_of(b):
                counts = _array(b"".join(x["totals"] for x in r["totals"]), np.int64)
                stream, sizes = _from_planes(r["stream"]), np.array(r["sizes"], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                logs = np.log10(counts + SMOOTH)
                emitted = sums_by(logs[stream], bounds)
                base = emitted - sizes * below + np.log10(t.ends + SMOOTH) - below
                known = sums_by((counts > 0).astype(np.int64)[stream], bounds) + (t.ends > 0)
                often = counts >= min_count
                number = np.where(often, np.cumsum(often) - 1, often.sum() + band(counts))
                kind = np.uint16 if number.max(initial=0) < 1 << 16 else np.uint32
                # words of one level are dealt over the classes it reaches into
                begin, end = first[:, log_level(counts[often])]
                words = _from_rising(r["vocabulary"])[often]
                share = mix(words) / 2.0 ** 64
                start = np.clip(np.floor(begin + share * (end - begin)), 0, classes - 1)
                row = [[r["run"]], [r["doc_ids"]], [r["train"]], [r["sizes"]], [number[stream].astype(kind).tobytes()],
                       [words.tobytes()], [counts[often].tobytes()], [start.astype(np.uint8).tobytes()],
                       [known.tolist()], [base.tolist()], [emitted.tolist()]]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(),
                         pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(row, types)],
                                                 names=[c.split()[0] for c in _NUMBERED.split(", ")])

    return joined.mapInArrow(one, _NUMBERED)


def _pairs(numbers: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and current number of every token including ends, and where documents begin."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    current = np.full(bounds[-1], end, dtype=np.int32)
    inside = np.ones(len(current), dtype=bool)
    inside[bounds[1:] - 1] = False
    current[inside] = numbers
    previous = np.concatenate([current[-1:], current[:-1]])
    return previous, current, bounds


def _numbers(r: dict, classes: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A run's numbers without ends, its documents' sizes, the class of every number, and its words."""
    own, sizes = _array(r["classes"], np.uint8), np.array(r["sizes"], np.int64)
    numbers = _array(r["numbers"], np.uint16 if len(r["numbers"]) == 2 * int(sizes.sum()) else np.uint32)
    return numbers, sizes, np.concatenate([own.astype(np.int32), classes + np.arange(bands + 1, dtype=np.int32)]), len(own)


def _stream(r: dict, classes: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A run's previous and current numbers, its documents' bounds, the class of every number, and its words."""
    numbers, sizes, of, k = _numbers(r, classes, bands)
    return *_pairs(numbers, sizes, k + bands), of, k


def _training(r: dict, classes: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a run's training documents: previous and current numbers, the classes of both, and the run's words."""
    numbers, sizes, of, k = _numbers(r, classes, bands)
    train = np.array(r["train"], bool)
    previous, current, _ = _pairs(numbers[np.repeat(train, sizes)], sizes[train], k + bands)
    after = of[current]
    return previous, current, np.concatenate([after[-1:], after[:-1]]), after, k


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as planes of bytes, as many as the greatest one needs; the first byte says how many."""
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return b"".join([bytes([wide]), *((values >> 8 * i).astype(np.uint8).tobytes() for i in range(wide))])


def _from_planes(planes: bytes) -> np.ndarray:
    first, *more = np.frombuffer(planes, dtype=np.uint8, offset=1).reshape(planes[0], -1)
    out = first.astype(np.uint32)
    for i, plane in enumerate(more, 1):
        out |= plane.astype(np.uint32) << np.uint32(8 * i)
    return out


def _rising(words: np.ndarray) -> bytes:
    """Sorted hashes as planes of bytes of their steps."""
    return np.ascontiguousarray(np.diff(words, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_rising(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _with_state(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Runs, which stay where their buckets are, with the classes of their words."""
    return runs.join(state.withColumnRenamed("run", "of").hint("shuffle_hash"), F.col("run") == F.col("of")).drop("of")


class Exchange:
    """Passes over the numbered runs; ``state`` tables hold every run's classes (run, classes)."""

    def __init__(self, numbered: DataFrame, tokens: int, classes: int, bands: int):
        self.runs = numbered.select("run", "train", "sizes", "numbers", "words")
        self.classes, self.bands, self.width = classes, bands, classes + bands + 1
        # at most so many bytes of counts: two entries of six bytes a token
        self.bits = max(0, int(np.ceil(np.log2(max(tokens * 12 / GROUP_BYTES, 1)))))

    def bigrams(self, state: DataFrame) -> np.ndarray:
        """The class bigrams alone, for which no word's counts travel."""
        classes, bands, width = self.classes, self.bands, self.width

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(width * width, dtype=np.int64)
            for b in batches:
                for r in rows_of(b):
                    _, _, before, after, _ = _training(r, classes, bands)
                    table += np.bincount(before * width + after, minlength=width * width)
            place = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(table[place])], names=["place", "n"])

        runs = _with_state(self.runs.drop("words"), state)
        total = np.zeros(width * width, dtype=np.int64)
        for r in runs.mapInArrow(one, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            total[r.place] = r.n
        return total.reshape(width, width)

    def counted(self, state: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """Per hash group the words, their classes and counts of the classes before and after them, with every run's
        words in that; and the class bigrams."""
        classes, bands, width, bits = self.classes, self.bands, self.width, self.bits
        schema = "part int, run long, words binary, classes binary, places binary, n binary"

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(width * width, dtype=np.int64)
            for b in batches:
                for r in rows_of(b):
                    previous, current, before, after, k = _training(r, classes, bands)
                    table += np.bincount(before * width + after, minlength=width * width)
                    # two sides of a word: the class before it, and the class after it; a last row is of numbers that are no words
                    kind = np.int32 if (k + 1) * 2 * width < 1 << 31 else np.int64
                    place = np.concatenate([np.minimum(current, k).astype(kind) * kind(2 * width) + before,
                                            np.minimum(previous, k).astype(kind) * kind(2 * width) + (width + after)])
                    # sorted numbers are counted in less time than a table of all places is filled and searched
                    place.sort()
                    new = np.ones(len(place), dtype=bool)
                    new[1:] = place[1:] != place[:-1]
                    begin = np.flatnonzero(new)
                    place, n = place[begin], np.diff(begin, append=len(place))
                    words = _array(r["words"], np.uint64)
                    cut = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, k])
                    at = np.searchsorted(place, cut * 2 * width)
                    some = np.flatnonzero(np.diff(cut))
                    own = _array(r["classes"], np.uint8)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some, pa.int32()), pa.array([r["run"]] * len(some), pa.int64()),
                        pa.array([words[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([own[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([_planes(np.diff(place[at[i]:at[i + 1]], prepend=cut[i] * 2 * width)) for i in some], pa.binary()),
                        pa.array([_planes(n[at[i]:at[i + 1]]) for i in some], pa.binary())],
                        names=["part", "run", "words", "classes", "places", "n"])
            # tables of many tasks are added up in some groups of their own
            yield pa.RecordBatch.from_arrays([
                pa.array([-1 - TaskContext.get().partitionId() % 64], pa.int32()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()),
                pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([table.tobytes()], pa.binary())],
                names=["part", "run", "words", "classes", "places", "n"])

        def meet(key, rows):
            part = key[0].as_py()
            if part < 0:
                total = sum(_array(x, np.int64) for x in rows.column("n").to_pylist())
                return pa.table({"part": pa.array([part], pa.int32()), "words": pa.array([b""], pa.binary()), "classes": pa.array([b""], pa.binary()),
                                 "counts": pa.array([b""], pa.binary()), "runs": pa.array([[]], pa.list_(pa.int64())),
                                 "slots": pa.array([[]], pa.list_(pa.binary())), "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})
            runs = rows.column("run").to_pylist()
            own = [_array(x, np.uint64) for x in rows.column("words").to_pylist()]
            words, first, slot = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
            of = np.concatenate([_array(x, np.uint8) for x in rows.column("classes").to_pylist()])[first]
            counts, begin, slots = np.zeros(len(words) * 2 * width, dtype=np.int64), 0, []
            for v, places, n in zip(own, rows.column("places").to_pylist(), rows.column("n").to_pylist()):
                mine = slot[begin:begin + len(v)]
                begin += len(v)
                place = np.cumsum(_from_planes(places).astype(np.int64))
                counts[place + ((mine - np.arange(len(mine))) * 2 * width)[place // (2 * width)]] += _from_planes(n)
                slots.append(mine.astype(np.uint32).tobytes())
            return pa.table({"part": pa.array([part], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()),
                             "classes": pa.array([of.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
                             "runs": pa.array([runs], pa.list_(pa.int64())), "slots": pa.array([slots], pa.list_(pa.binary())),
                             "sums": pa.array([np.bincount(of, minlength=classes).tolist()], pa.list_(pa.int64()))})

        packed = _with_state(self.runs, state).mapInArrow(one, schema)
        counts = stage(packed.groupBy("part").applyInArrow(
            meet, "part int, words binary, classes binary, counts binary, runs array<long>, slots array<binary>, sums array<long>"))
        # at most 64 tables
        tables = [np.array(r.sums, dtype=np.int64) for r in counts.filter("part < 0").select("sums").collect()]
        return counts, sum(tables, np.zeros(width * width, dtype=np.int64)).reshape(width, width)

    def kinds(self, counts: DataFrame) -> np.ndarray:
        """How many words each class has."""
        rows = counts.filter("part >= 0").select(F.posexplode("sums").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(self.classes, dtype=np.int64)
        for r in rows:
            out[r["class"]] = r.n
        return out

    def moved(self, state: DataFrame, counts: DataFrame, table: np.ndarray, half: int | None) -> DataFrame:
        """The state after all words (of one half) took their best class, judged by the classes around them."""
        classes, width = self.classes, self.width
        logs, mass = np.log(table + SMOOTH), np.log(np.maximum(table.sum(axis=1), SMOOTH))

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in rows_of(b):
                    words, of = _array(r["words"], np.uint64), _array(r["classes"], np.uint8).copy()
                    n = _array(r["counts"], np.int64).reshape(len(words), 2, width)
                    mine = np.arange(len(words)) if half is None else np.flatnonzero(mix(words) & np.uint64(1) == half)
                    gain = n[mine, 1] @ logs[:classes].T + n[mine, 0] @ logs[:, :classes] - 2 * n[mine, 1].sum(axis=1)[:, None] * mass[:classes]
                    # a class no better than its own does not move a word
                    best, now = gain.argmax(axis=1), of[mine].astype(np.int64)
                    of[mine] = np.where(gain.max(axis=1) > gain[np.arange(len(mine)), now], best, now)
                    for run, slots in zip(r["runs"], r["slots"]):
                        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([r["part"]], pa.int32()),
                                                          pa.array([of[_array(slots, np.uint32)].tobytes()], pa.binary())], names=["run", "part", "classes"])

        answers = counts.filter("part >= 0").mapInArrow(decide, "run long, part int, classes binary").groupBy(F.col("run").alias("of")).agg(
            F.sort_array(F.collect_list(F.struct("part", "classes"))).alias("new"))
        joined = state.join(answers, F.col("run") == F.col("of"), "left")
        # slices of the hash ranges, in their order, are the run's words in theirs
        whole = F.aggregate("new", F.unhex(F.lit("")), lambda so_far, x: F.concat(so_far, x["classes"]))
        return stage(joined.select("run", F.coalesce(whole, F.col("classes")).alias("classes")))


def likelihood(table: np.ndarray) -> float:
    x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
    return x(table) - x(table.sum(axis=0)) - x(table.sum(axis=1))


@dataclass(frozen=True)
class Model:
    """Class bigrams, words of every class, and the runs' states with what a run's scores need."""

    totals: Totals
    table: np.ndarray
    kinds: np.ndarray
    numbered: DataFrame
    state: DataFrame
    classes: int
    #: Likelihoods of the states that were accepted.
    steps: tuple[float, ...]


def train(docs: DataFrame, min_count: int = MIN_COUNT, classes: int = CLASSES) -> Model:
    runs = stage(token_runs(docs))
    sums = runs.agg(F.sum("trained"), F.sum("ends"), F.sum("words")).first()
    tokens, ends, words = (int(x or 0) for x in sums)
    bands = int(band(np.array([min_count - 1]))[0]) + 1
    answers = stage(_counted(runs, words, min_count))
    totals, first = _totals(answers, tokens, ends, bands, classes)
    # every pass joins the runs with their classes: the runs are dealt out once
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // (4 * RUN_TOKENS))
    joined = stage(_numbered(runs, answers, totals, first, min_count, classes))
    release_staged(runs)
    release_staged(answers)
    numbered = stage_bucketed(joined, "run", buckets)
    release_staged(joined)
    passes = Exchange(numbered, tokens, classes, bands)
    state = numbered.select("run", "classes")
    counts, table = passes.counted(state)
    steps, half, failed, owned = [likelihood(table)], None, 0, False
    while failed < 2:
        newer = passes.moved(state, counts, table, half)
        least, its_counts = GAIN * abs(steps[-1]), None
        # moves of a half may well be undone: the class bigrams are seen before words are counted
        if half is not None:
            its_table = passes.bigrams(newer)
        else:
            its_counts, its_table = passes.counted(newer)
        value = likelihood(its_table)
        gains = value > steps[-1] + least
        if gains:
            if its_counts is None:
                its_counts, _ = passes.counted(newer)
            if owned:
                release_staged(state)
            release_staged(counts)
            state, counts, table, owned = newer, its_counts, its_table, True
            steps.append(value)
        else:
            release_staged(newer)
            if its_counts is not None:
                release_staged(its_counts)
        if half is not None:
            failed = 0 if gains else failed + 1
            half = 1 - half
        elif not gains:
            half = 0
    kinds = passes.kinds(counts)
    release_staged(counts)
    return Model(totals, table, kinds, numbered, state, classes, tuple(steps))


def word_classes(model: Model) -> DataFrame:
    """``word`` (64-bit hash), ``n``, ``class`` of every clustered word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array(_array(r["words"], np.int64)), pa.array(_array(r["n"], np.int64)),
                                                  pa.array(_array(r["classes"], np.uint8).astype(np.int32))], names=["word", "n", "class"])

    rows = _with_state(model.numbered.select("run", "words", "n"), model.state)
    return rows.mapInArrow(run, "word long, n long, class int").distinct()


def scored(model: Model) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    t, classes, table = model.totals, model.classes, model.table
    bands, width = len(t.band_words), len(table)
    step = np.log10((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * width))
    # words of a class share its tokens, one more stands for those never seen
    held, kinds = table.sum(axis=0), np.concatenate([model.kinds, t.band_words, [0]])
    share = np.log10(held + SMOOTH * (kinds + 1))
    share[-1] = 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                previous, current, bounds, of, _ = _stream(r, classes, bands)
                a, c = of[previous], of[current]
                total = sums_by(step[a, c] - share[c], bounds) + np.array(r["emitted"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array([not x for x in r["train"]], pa.bool_()),
                    pa.array(np.diff(bounds), pa.int64()), pa.array(r["known"], pa.int64()),
                    pa.array(np.full(len(bounds) - 1, t.tokens), pa.int64()), pa.array(r["base"], pa.float64()),
                    pa.array(total, pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = _with_state(model.numbered.drop("classes", "words", "n"), model.state)
    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")


def scores(docs: DataFrame, min_count: int = MIN_COUNT, classes: int = CLASSES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    model = train(docs, min_count, classes)
    out = stage(scored(model))
    release_staged(model.numbered)
    return out
