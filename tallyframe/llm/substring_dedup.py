"""Removal of long repeated substrings, with merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

1. Copies of a text are put together: every one but that with the smallest id goes as a whole. Distinct texts, with
   that id, are written as runs (one after another), each up to about four megabytes.
2. Every window of ``LENGTH`` bytes names an anchor, the place of its smallest hash of 24 bytes; equal windows
   have equal anchors, and neighbouring windows mostly share one. Runs report their distinct anchors (six bytes
   each), and hear which of them other documents have too. Only there can windows repeat.
3. For such anchors, the bytes that its windows cover are sent by anchor: equal stretches of a run once, with
   the smallest id that has them. Each group of anchors is cut, between anchors, into collections of about a megabyte,
   whose shard transforms are merged by interleave refinement; blocks of rows with a common prefix of ``LENGTH`` are
   the repeated windows, and the smallest id in a block tells which documents lose theirs.
4. Removed windows go back to their run, where bytes are taken out.

Every run sends a row to nearly every group, so there are runs times groups of them: runs are long, and from ``GROUPS``
groups on it is the groups that grow with the corpus, up to ``GROUP_MOST``. A row's fixed cost so is a small part of the
work up to some 100 GB of text; beyond that it grows with the square of the corpus, at a small factor. All arrays over
runs and groups that are larger than these are made a slice at a time.

An anchor in many documents (``HOT``, counted over the corpus) sends its windows one by one under their own
hash instead, so that differing windows of a frequent passage spread over all groups; equal windows are one per
run in either case. Windows of an anchor in very many documents (``VERY_HOT``) go to no group: their smallest ids are a
grouped minimum of rows, combined before the shuffle, and are joined back to the runs, which adaptive execution
splits; so no task holds a row of every run for a passage that all runs have. Documents are counted up to 255 a run, so
both limits are approximate; they choose the way, never the result.

Missing texts are empty; texts below ``LENGTH`` lose nothing; a missing id counts as larger than any other, and
rows with equal ids never remove each other's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.merged_bwt import repeated
from tallyframe.llm.tables import content_key, rows_of
from tallyframe.llm.text_arrays import chunks, mix, powers
from tallyframe.session import release_staged, stage

LENGTH, GRAM = 50, 24
RUN_BYTES, SHARD_BYTES, GROUP_BYTES, GROUP_ANCHORS = 4 << 20, 1 << 15, 4 << 20, 2_000_000
#: Groups of stretches from which on they grow with the corpus, their most bytes, and bytes merged at a time.
GROUPS, GROUP_MOST, COLLECTION_BYTES = 2048, 32 << 20, 1 << 20
#: Stretches (or windows of hot ones) that are sorted and sent at a time, windows compared at a time, bytes in a batch.
SENT, COMPARED, BATCH_BYTES = 1 << 18, 1 << 20, 1 << 20
#: Documents with an anchor beyond which its windows are spread, and beyond which they are rows of their own.
HOT, VERY_HOT = 10_000, 1_000_000
_NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 48) - 1)
#: Windows that share an anchor, on average.
_SPACING = (LENGTH - GRAM + 2) / 2
#: Windows handled at a time, and bits for a place among them.
_SLICE, _PLACE = 1 << 16, 17
_MIX_A, _MIX_B, _MIX_C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9))
_SEED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def runs_of(docs: DataFrame) -> DataFrame:
    """``run, keys, doc_ids, sizes, text``: distinct texts one after another, with their smallest ids."""
    texts = docs.select(content_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, keys, ids, sizes, texts = TaskContext.get().partitionId() << 32, 0, [], [], [], []

        def run():
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([b"".join(texts)], pa.binary())], names=["run", "keys", "doc_ids", "sizes", "text"])

        for batch in batches:
            for t in chunks(batch.column("text")):
                keys += batch.column("key").slice(t.first, len(t)).to_pylist()
                ids += batch.column("doc_id").slice(t.first, len(t)).to_pylist()
                sizes += np.diff(t.offsets).tolist()
                texts.append(t.data.tobytes())
                held += len(t.data)
                if held >= RUN_BYTES:
                    yield run()
                    number, held, keys, ids, sizes, texts = number + 1, 0, [], [], [], []
        if ids:
            yield run()

    return texts.mapInArrow(cut, "run long, keys array<binary>, doc_ids array<long>, sizes array<int>, text binary")


def _anchor_places(data: np.ndarray) -> np.ndarray:
    """For every window of ``LENGTH`` bytes: the hash of its anchor (high bits) and the anchor's place (low
    ``_PLACE`` bits), in one number, so that the smallest is the leftmost of the smallest hashes."""
    x, step = data.astype(np.uint64), 1
    while step < 8:  # eight bytes at every place
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
        step *= 2
    h = (x[:-16] ^ (x[8:-8] * _MIX_A)) * _MIX_B + x[16:] * _MIX_C
    h ^= h >> np.uint64(29)
    h *= _MIX_A
    h = (h >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, step = LENGTH - GRAM + 1, 1
    while 2 * step <= wide:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:len(h) - (wide - step)], h[wide - step:]) if wide > step else h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that share an anchor: text, first and last window start, hash of the anchor."""
    windows = max(len(data) - LENGTH + 1, 0)
    inside, first = np.ones(windows, dtype=bool), np.zeros(windows, dtype=bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[max(begin, end - LENGTH + 1):end] = False
        first[begin:begin + 1] = True
    starts, hashes, before = [], [], -1
    for at in range(0, windows, _SLICE):
        here = _anchor_places(data[at:at + _SLICE + LENGTH - 1])
        where = (here & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + at
        new = first[at:at + len(here)]
        new[0] |= where[0] != before
        new[1:] |= where[1:] != where[:-1]
        before = where[-1]
        start = np.flatnonzero(new & inside[at:at + len(here)])
        starts.append(start + at)
        hashes.append(here[start] >> np.uint64(_PLACE))
    start = np.concatenate([np.zeros(0, np.int64), *starts])
    doc = np.searchsorted(offsets, start, side="right") - 1
    last = np.minimum(np.append(start[1:], windows) - 1, offsets[doc + 1] - LENGTH)
    return doc, start, last, mix(np.concatenate([np.zeros(0, np.uint64), *hashes]))


def _run_anchors(text, sizes: list[int]):
    """Bytes of a run, where its documents begin, and their anchors."""
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
    data = np.frombuffer(text, dtype=np.uint8)
    return data, offsets, *anchors(data, offsets)


def _planes(values: np.ndarray) -> bytes:
    """48-bit values as planes of bytes, which compress where values are sorted."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(planes, dtype=np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _groups(amount: float, each: float) -> int:
    """Bits of a hash that deal ``amount`` into groups of about ``each``."""
    return max(0, int(np.ceil(np.log2(max(amount / each, 1)))))


def _stretch_groups(amount: float) -> int:
    """Bits of a hash that deal ``amount`` bytes of stretches into groups."""
    return _groups(amount, min(max(GROUP_BYTES, amount / GROUPS), max(GROUP_BYTES, GROUP_MOST)))


def _group_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def shared_anchors(runs: DataFrame, size: int) -> DataFrame:
    """``run, shared, hot, n``: the anchors of a run that several documents have, as packed sorted hashes, and how hot
    each is (0, 1 or 2)."""
    bits = _groups(size / _SPACING, GROUP_ANCHORS)

    def report(batches):
        for b in batches:
            for i, (run, sizes) in enumerate(zip(*[b.column(c).to_pylist() for c in ("run", "sizes")])):
                _, _, doc, _, _, h = _run_anchors(b.column("text")[i].as_buffer(), sizes)
                if not len(h):
                    continue
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                other = new.copy()
                other[1:] |= doc[1:] != doc[:-1]
                at = np.flatnonzero(new)
                documents = np.minimum(np.add.reduceat(other.astype(np.int64), at), 255).astype(np.uint8)
                h = h[at]
                group = _group_of(h, bits)
                cut = np.searchsorted(group, np.arange((1 << bits) + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(1 << bits), pa.int32()), pa.array([run] * (1 << bits), pa.int64()),
                    pa.array([_planes(h[a:b] >> np.uint64(max(0, 16 - bits)) & _LOW) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([documents[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["part", "run", "anchors", "documents"])

    def meet(key, table):
        hs = [_values(x) for x in table.column("anchors").to_pylist()]
        n = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table.column("documents").to_pylist()])
        values, place = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(place, n, len(values))
        ends, rows = np.cumsum([len(h) for h in hs]), []
        for run, h, end in zip(table.column("run").to_pylist(), hs, ends):
            here = total[place[end - len(h):end]]
            level = (here > HOT).astype(np.uint8) + (here > VERY_HOT)
            rows.append((run, key[0].as_py(), _planes(h[here > 1]), level[here > 1].astype(np.uint8).tobytes(), int((here > 1).sum())))
        return pa.table({"run": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()),
                         "shared": pa.array([r[2] for r in rows], pa.binary()), "hot": pa.array([r[3] for r in rows], pa.binary()),
                         "n": pa.array([r[4] for r in rows], pa.int64())})

    told = runs.select("run", "sizes", "text").mapInArrow(report, "part int, run long, anchors binary, documents binary")
    return told.groupBy("part").applyInArrow(meet, "run long, part int, shared binary, hot binary, n long").filter("n > 0")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, at least ``n``."""
    global _known_powers
    if len(_known_powers[0]) < n:
        base = 0xD1342543DE82EF95
        _known_powers = powers(n, np.uint64(base)), powers(n, np.uint64(pow(base, -1, 1 << 64)))
    return _known_powers


_known_powers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)


def _stretch_hash(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, in order of their begins, from prefix sums that let stretches overlap."""
    out = np.zeros(len(first), dtype=np.uint64)
    i = 0
    while i < len(first):
        low = int(first[i])
        j = int(np.searchsorted(first, low + _SLICE))
        high = int(end[i:j].max())
        up, down = _powers(max(high - low, _SLICE))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_SEED[data[low:high]] * up[:high - low], out=sums[1:])
        a = first[i:j] - low
        out[i:j] = (sums[end[i:j] - low] - sums[a]) * down[a]
        i = j
    return mix(out + (end - first).astype(np.uint64))


#: Of stretches in a group: 32 bits of their names, their sizes and bytes; and of all places where documents have them, in
#: their order, whether another stretch begins, and planes of window starts and ids. Part -1 has windows of very hot anchors:
#: two hashes (``names``, ``lowest``), starts and ids.
_STRETCHES = "part int, run long, names binary, sizes binary, bytes binary, lowest binary, new binary, starts binary, ids binary"
_COLUMNS = [c.split()[0] for c in _STRETCHES.split(", ")]


def stretches(runs: DataFrame, shared: DataFrame, bits: int, anchor_bits: int) -> DataFrame:
    """Distinct stretches of a run under shared anchors, by group of anchors, and where documents have them."""
    told = shared.groupBy(F.col("run").alias("of_run")).agg(F.collect_list(F.struct("part", "shared", "hot")).alias("told"))
    rows = runs.join(told, F.col("run") == F.col("of_run")).select("run", "doc_ids", "sizes", "text", "told")

    def one(batches):
        for b in batches:
            for r in rows_of(b):
                yield from _cut_stretches(r, bits, anchor_bits)

    return rows.mapInArrow(one, _STRETCHES)


def _cut_stretches(r: dict, bits: int, anchor_bits: int) -> Iterator[pa.RecordBatch]:
    data, _, doc, first, last, h = _run_anchors(r["text"], r["sizes"])
    ids = np.array(r["doc_ids"], dtype=np.int64)
    # parts are the highest bits of hashes, and what is told follows them, so all parts together are sorted
    told = sorted(r["told"], key=lambda t: t["part"])
    over = np.uint64(max(0, anchor_bits - 16))
    known = np.concatenate([_values(t["shared"]) | (np.uint64(t["part"]) >> over) << np.uint64(48) for t in told])
    hot = np.frombuffer(b"".join(t["hot"] for t in told), dtype=np.uint8)
    short = h >> np.uint64(max(0, 16 - anchor_bits))
    place = np.minimum(np.searchsorted(known, short), len(known) - 1)
    state = np.where(known[place] == short, 1 + hot[place], 0)
    chosen = np.flatnonzero(state)
    sent = np.cumsum(np.where(state[chosen] == 1, 1, (last - first + 1)[chosen]))
    at = 0
    while at < len(chosen):
        to = max(at + 1, int(np.searchsorted(sent, (sent[at - 1] if at else 0) + SENT, side="right")))
        yield from _sent_stretches(r["run"], data, ids, *[x[chosen[at:to]] for x in (doc, first, last, h, state)], bits)
        at = to


def _sent_stretches(run: int, data: np.ndarray, ids: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray,
                    state: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of some of a run's stretches, each a row per group."""

    def single(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and texts of all windows of some stretches."""
        windows = (last - first + 1)[chosen]
        each = np.repeat(first[chosen], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        return each, np.repeat(doc[chosen], windows)

    once, frequent = np.flatnonzero(state == 1), np.flatnonzero(state == 3)
    if len(frequent):
        each, of = single(frequent)
        yield _packed_row(-1, run, [
            _stretch_hash(data, each, each + LENGTH), b"", b"", _stretch_hash(data, each + 1, each + LENGTH - 1), b"",
            each.astype(np.int32), ids[of]])
    each, spread_of = single(np.flatnonzero(state == 2))
    begin = np.concatenate([first[once], each])
    end = np.concatenate([last[once], each]) + LENGTH
    of = np.concatenate([doc[once], spread_of])
    content = np.concatenate([_stretch_hash(data, begin[x], end[x]) for x in (slice(len(once)), slice(len(once), None))])
    # anchors go where their hash says, spread windows where their own does
    name = mix(np.concatenate([h[once], content[len(once):]]))
    order = np.lexsort((ids[of], content, name))
    name, content, begin, end, owner = name[order], content[order], begin[order], end[order], ids[of][order]
    if not len(name):
        return
    part = _group_of(name, bits)
    new = np.ones(len(part), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (content[1:] != content[:-1])
    at = np.flatnonzero(new)
    size = (end - begin)[at]
    # where parts begin among places, among distinct stretches and in their text
    places = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    distinct = np.searchsorted(at, places)
    whole = memoryview(data)
    text = b"".join([whole[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist())])
    # names only bring stretches together, so 32 bits are enough below those of the part
    short = (name[at] << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    rows = pa.RecordBatch.from_arrays([
        pa.array(part[places[:-1]], pa.int32()), pa.array(np.full(len(places) - 1, run), pa.int64()), _packed(short, distinct * 4),
        _packed(size.astype(np.uint8), distinct), _packed(text, np.concatenate([[0], np.cumsum(size)])[distinct]),
        _packed(b"", distinct * 0), _packed(new.view(np.uint8), places), _packed_planes(begin.astype(np.int32), places),
        _packed_planes(owner, places)], names=_COLUMNS)
    each = max(1, int(len(rows) * BATCH_BYTES / rows.nbytes))
    for k in range(0, len(rows), each):
        yield rows.slice(k, each)


def _packed(values: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after another, with the places in bytes where they begin and end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another as numbers, and how many there are in each."""
    values = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return data[offsets[0]:offsets[-1]].view(kind), np.diff(offsets) // size


def _plane_places(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first bytes of values stand if those of a row stand together, then their second bytes, and so on; and how
    far the next bytes are away."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(before * (width - 1), counts), np.repeat(counts, counts)


def _packed_planes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """As :func:`_packed`, as planes of bytes, which compress. ``offsets`` count values."""
    width = values.itemsize
    first, step = _plane_places(np.diff(offsets), width)
    out = np.empty(len(values) * width, dtype=np.uint8)
    for k in range(width):
        out[first + k * step] = values.view(np.uint8)[k::width]
    return _packed(out, offsets * width)


def _joined_planes(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_joined`, of planes."""
    width = np.dtype(kind).itemsize
    data, counts = _joined(column, np.uint8)
    first, step = _plane_places(counts // width, width)
    out = np.empty((len(first), width), dtype=np.uint8)
    for k in range(width):
        out[:, k] = data[first + k * step]
    return out.reshape(-1).view(kind), counts // width


def _packed_row(part: int, run: int, values: list) -> pa.RecordBatch:
    packed = [v if isinstance(v, bytes) else v.tobytes() for v in values]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.int64()), *[pa.array([v], pa.binary()) for v in packed]],
                                      names=_COLUMNS)


def _lowest_ids(names: np.ndarray, begin: np.ndarray, sizes: np.ndarray, text: np.ndarray, lowest: np.ndarray):
    """Per window of every distinct stretch the smallest id of a document that has the window; and where each
    stretch's windows begin. Equal stretches have been put together, so ``names``, which are in order, may repeat,
    contents not."""
    windows = sizes - LENGTH + 1
    bounds = np.concatenate([[0], np.cumsum(windows)])
    out = np.repeat(lowest, windows)
    same = names[1:] == names[:-1]
    chosen = np.flatnonzero(np.append(same, False) | np.concatenate([[False], same]))
    if not len(chosen):
        return out, bounds
    # collections: whole names, about so many bytes
    heads = np.flatnonzero(np.concatenate([[True], names[chosen][1:] != names[chosen][:-1]]))
    before = (np.cumsum(sizes[chosen]) - sizes[chosen])[heads]
    cuts = heads[np.concatenate([[True], before[1:] // COLLECTION_BYTES != before[:-1] // COLLECTION_BYTES])]
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chosen)]):
        _lower(out, bounds, chosen[low:high], begin, sizes, text)
    return out, bounds


def _lower(out: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, begin: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> None:
    """Put the smallest id of equal windows of the ``chosen`` stretches into ``out``."""
    # the strings of the collection: characters above 0, a 0 after each
    size = sizes[chosen]
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    strings = np.zeros(int((size + 1).sum()), dtype=np.uint16)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    strings[np.repeat(starts, size) + place] = text[np.repeat(begin[chosen], size) + place].astype(np.uint16) + 1
    suffix, block = repeated(strings, starts, LENGTH, SHARD_BYTES)
    if len(suffix):
        string = np.searchsorted(starts, suffix, side="right") - 1
        window = bounds[chosen[string]] + suffix - starts[string]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        smallest = np.minimum.reduceat(out[window], first)
        out[window] = np.repeat(smallest, np.diff(np.append(first, len(block))))


def removed_windows(found: DataFrame) -> DataFrame:
    """``run, ranges``: first and last starts of windows that go, as pairs."""

    def meet(key, table):
        names, sizes = _joined(table.column("names"), np.uint32)[0], _joined(table.column("sizes"), np.uint8)[0].astype(np.int64)
        text = _joined(table.column("bytes"), np.uint8)[0]
        (starts, places), owner = _joined_planes(table.column("starts"), np.int32), _joined_planes(table.column("ids"), np.int64)[0]
        # places of a stretch are in the order of their ids
        other = _joined(table.column("new"), np.uint8)[0]
        lowest = owner[np.flatnonzero(other)]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        content = _stretch_hash(text, begin[:-1], begin[1:])
        # equal stretches of several runs are one
        order = np.lexsort((content, names))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (names[order][1:] != names[order][:-1]) | (content[order][1:] != content[order][:-1])
        at = np.flatnonzero(new)
        one = order[at]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        ids, bounds = _lowest_ids(names[one], begin[one], sizes[one], text, np.minimum.reduceat(lowest[order], at))
        row = np.repeat(np.arange(len(table)), places)
        packed, n = _ranges(ids, bounds, number[np.cumsum(other, dtype=np.int64) - 1], row, starts, owner)
        kept = np.unique(n)
        ends = np.append(np.searchsorted(n, kept), len(n)) * 8
        return pa.table({"run": table.column("run").take(pa.array(kept)), "ranges": _packed(packed, ends)})

    return found.filter("part >= 0").groupBy("part").applyInArrow(meet, "run long, ranges binary")


def removed_frequent_windows(found: DataFrame) -> DataFrame:
    """``run, ranges`` of the windows that are rows of their own, told apart by two hashes."""

    def opened(b: pa.RecordBatch, i: int) -> list[np.ndarray]:
        kinds = {"names": np.int64, "lowest": np.int64, "starts": np.int32, "ids": np.int64}
        return [np.frombuffer(b.column(c)[i].as_buffer(), dtype=k) for c, k in kinds.items()]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                one, other, _, ids = opened(b, i)
                order = np.lexsort((ids, other, one))
                one, other, ids = one[order], other[order], ids[order]
                new = np.ones(len(one), dtype=bool)
                new[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(one[new]), pa.array(other[new]), pa.array(ids[new])], names=["a", "b", "id"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                one, other, starts, ids = opened(b, i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), b.column("run")[i].as_py())), pa.array(one), pa.array(other),
                                                  pa.array(starts), pa.array(ids)], names=["run", "of_a", "of_b", "start", "id"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for starts in b.column("starts").to_pylist():
                where = np.sort(np.array(starts, dtype=np.int64))
                at = np.flatnonzero(np.concatenate([[True], where[1:] > where[:-1] + 1]))
                packed.append(np.column_stack([where[at], where[np.append(at[1:], len(where)) - 1]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(packed, pa.binary())], names=["run", "ranges"])

    rows = found.filter("part < 0").select("run", "names", "lowest", "starts", "ids")
    lowest = stage(rows.mapInArrow(least, "a long, b long, id long").groupBy("a", "b").agg(F.min("id").alias("lowest")))
    places = rows.mapInArrow(every, "run long, of_a long, of_b long, start int, id long")
    gone = places.join(lowest, (F.col("of_a") == F.col("a")) & (F.col("of_b") == F.col("b"))).filter(F.col("lowest") < F.col("id"))
    # a run's places are bounded by its bytes
    return gone.groupBy("run").agg(F.collect_list("start").alias("starts")).mapInArrow(ranges, "run long, ranges binary")


def _ranges(ids: np.ndarray, bounds: np.ndarray, stretch: np.ndarray, row: np.ndarray, starts: np.ndarray,
            owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of window starts whose window a smaller id has, as pairs, and the row of each: they are sorted by row."""
    windows = bounds[stretch + 1] - bounds[stretch]
    done, pairs, rows, at = np.cumsum(windows), [], [], 0
    while at < len(row):
        # whole rows, about so many windows; ranges of a longer row may be cut in two
        to = int(np.searchsorted(row, row[min(int(np.searchsorted(done, done[at] + COMPARED)), len(row) - 1)], side="right"))
        to = min(to, int(np.searchsorted(done, done[at] + 2 * COMPARED)) + 1)
        w = windows[at:to]
        place = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        goes = ids[np.repeat(bounds[stretch[at:to]], w) + place] < np.repeat(owner[at:to], w)
        key = np.sort((np.repeat(row[at:to].astype(np.int64) << 32 | starts[at:to], w) + place)[goes])
        first = np.flatnonzero(np.concatenate([[True], key[1:] > key[:-1] + 1])[:len(key)])
        last = key[np.append(first[1:], len(key))[:len(first)] - 1]
        pairs.append(np.column_stack([key[first], last]).astype(np.uint32).view(np.int32))
        rows.append(key[first] >> 32)
        at = to
    return np.concatenate(pairs), np.concatenate(rows)


def _removed(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run's bytes, where its documents begin, and which bytes go."""
    data = np.frombuffer(r["text"], dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.array(r["sizes"], dtype=np.int64))])
    # a byte lies in fewer than LENGTH ranges
    change = np.zeros(len(data) + 1, dtype=np.int16)
    for x in r["ranges"] or []:
        pairs = np.frombuffer(x, dtype=np.int32).reshape(-1, 2).astype(np.int64)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1] + LENGTH, -1)
    return data, offsets, np.cumsum(change[:-1], dtype=np.int16) > 0


def _with_ranges(docs: DataFrame) -> DataFrame:
    runs = stage(runs_of(docs))
    size = runs.agg(F.sum(F.length("text"))).first()[0] or 0
    shared = stage(shared_anchors(runs, size))
    n = shared.agg(F.sum("n")).first()[0] or 0
    bits = _stretch_groups(n * (_SPACING + LENGTH))
    # staged in between, so that the join's shuffle files are gone before stretches are shuffled
    found = stage(stretches(runs, shared, bits, _groups(size / _SPACING, GROUP_ANCHORS)))
    release_staged(shared)
    removed = removed_windows(found)
    if not found.filter("part < 0").select("part").isEmpty():
        removed = removed.union(removed_frequent_windows(found))
    removed = stage(removed)
    release_staged(found)
    of_run = removed.groupBy(F.col("run").alias("of_run")).agg(F.collect_list("ranges").alias("ranges"))
    return runs.join(of_run, F.col("run") == F.col("of_run"), "left").select("keys", "sizes", "text", "ranges", "doc_ids")


def _results(docs: DataFrame, schema: str, one) -> DataFrame:
    """Results of distinct texts by ``one`` (bytes, which of them go), for every row of ``docs``: ``first`` tells
    whether the row has the smallest id of its text or is too short to lose anything, so the result is its own."""

    def run(batches):
        for b in batches:
            for r in rows_of(b):
                data, offsets, goes = _removed(r)
                found = [one(data[x:y], goes[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["keys"], pa.binary()), pa.array(r["doc_ids"], pa.int64()),
                    *[pa.array([f[k] for f in found], t) for k, t in enumerate(one.types)]],
                    names=["key", "lowest", *one.names])

    results = _with_ranges(docs).mapInArrow(run, f"key binary, lowest long, {schema}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("of_key"),
                       F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    own = (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("lowest")) | (F.col("bytes") < LENGTH)
    return rows.join(results, F.col("of_key") == F.col("key")).withColumn("first", own)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, text, removed`` of every row: what is left as bytes, and the removed runs as begin, end pairs."""

    def one(data: np.ndarray, goes: np.ndarray):
        edge = np.diff(np.concatenate([[0], goes.astype(np.int8), [0]]))
        return data[~goes].tobytes(), np.flatnonzero(edge).tolist()

    one.names, one.types = ["text", "removed"], [pa.binary(), pa.list_(pa.int32())]
    found = _results(docs, "text binary, removed array<int>", one)
    return found.select("doc_id", F.when(F.col("first"), F.col("text")).otherwise(F.lit(b"")).alias("text"), F.when(
        F.col("first"), F.col("removed")).otherwise(F.array(F.lit(0), "bytes")).alias("removed"))


def report(docs: DataFrame) -> DataFrame:
    def one(data: np.ndarray, goes: np.ndarray):
        return (len(data), int(goes.sum()), int((goes[1:] & ~goes[:-1]).sum() + goes[:1].sum()),
                hashlib.sha256(data[~goes].tobytes()).hexdigest())

    one.names, one.types = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 3 + [pa.string()]
    found = _results(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", one)
    return found.select("doc_id", "n_bytes", *[
        F.when(F.col("first"), F.col(c)).otherwise(other).alias(c) for c, other in (
            ("n_removed", F.col("n_bytes")), ("n_spans", F.lit(1).cast("long")), ("kept_sha256", F.sha2(F.lit(""), 256)))])


REPORT_SQL = """
with rows as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as materialized (
  select r, doc_id, i, substr(h, 2 * i - 1, 100) as s
  from (select *, unnest(range(1, greatest(strlen(h) // 2 - 49, 0) + 1)) as i from rows)),
lowest as (select s, min(doc_id) as least from windows group by s having count(*) > 1),
gone as (select distinct r, k from (
  select r, unnest(range(i, i + 50)) as k from windows join lowest using (s) where doc_id > least)),
runs as (select r, count(*) as n, count(*) filter (where before is null or before < k - 1) as spans from (
  select r, k, lag(k) over (partition by r order by k) as before from gone) group by r),
kept as (
  select r, string_agg(substr(h, 2 * k - 1, 2), '' order by k) as left_over from (
    select r, h, unnest(range(1, strlen(h) // 2 + 1)) as k from rows where r in (select r from runs))
  where (r, k) not in (select (r, k) from gone) group by r)
select doc_id, (strlen(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then h else coalesce(left_over, '') end)) as kept_sha256
from rows left join runs using (r) left join kept using (r)
"""
