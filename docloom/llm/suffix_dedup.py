"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a LENGTH-byte string that also starts anywhere else is removed. Suffixes only
matter up to LENGTH bytes here ("windows"), and they are sorted where equal ones must meet:

1. Each window has an anchor, the position of the smallest K-gram hash in it (leftmost of equals), so
   equal windows have equal anchors at equal offsets. Neighbouring windows share anchors: about one
   in 80 positions is one. A first scan counts anchor hashes (each task sends a hash once, so a
   passage in a third of all texts costs no more than one row a task).
2. A second scan takes the runs of windows ("segments") whose anchor is marked in a bit table as
   occurring twice (the table only saves work and may mark too much), and sends their digests and
   places. Segments that occur twice as a whole are repeats throughout.
3. A third scan sends the bytes of segments whose anchor has several different ones, from one of the
   texts that hold them. The segments of an anchor are brought together, and for each offset their
   suffixes are mergesorted: two suffixes are compared by binary search for their common extension
   over prefix polynomial hashes, then by the next byte, so a comparison takes log2(LENGTH) steps.
   Neighbours that agree in LENGTH bytes are compared byte by byte against hash collisions, and both
   windows are repeats.
   Segments of an anchor with over MANY different ones are cut into *pieces* first: the windows of
   WIDTH neighbouring offsets. All windows of a piece hold the same LENGTH - WIDTH + 1 bytes (its
   core), so only pieces of equal cores need be sorted together; equal pieces count once.
4. Ranges go back to their rows. A last scan sends the texts of rows that are cut in part, to be
   joined with their ranges by SHA-256; what remains is joined and hashed.

Segments are known by their anchor's hash and a digest of 64 bits each; segments that are equal as a
whole by these 128 bits are not compared byte by byte.

Defined results: a null text is empty; texts shorter than LENGTH bytes stay whole; matches never
cross documents; overlapping occurrences in one document count; repeated rows remove each other
whole; strings are judged on the input, not on what is left; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import work
from docloom.llm.shingles import blocks, mix
from docloom.shipping import ship
from docloom.staging import spread

LENGTH = 200
K = 48
#: Bytes of text that are cut into segments together: a window takes about 80 bytes meanwhile.
BLOCK = 1 << 18
#: Bits of the number of marks (16 for each hash that is marked, within these bounds).
MARKS = (20, 27)
#: Bits of the number of parts in which anchors are counted: the least; more where a part would exceed PART_BYTES.
PARTS, PART_BYTES = 10, 16 << 20
#: Anchors with more different segments have them cut into pieces of WIDTH offsets.
MANY, WIDTH = 1000, 16
_HELD = 1 << 20
#: Windows sorted together in a task.
_SORT = 1 << 17
_S = np.uint64
_BASE = _S(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=_S) * _S(2) + _S(1)
_pow = np.ones(1, _S)
_inv = np.ones(1, _S)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        _pow = np.concatenate([[_S(1)], np.cumprod(np.full(n, _BASE))])
        back = _S(pow(int(_BASE), -1, 1 << 64))
        _inv = np.concatenate([[_S(1)], np.cumprod(np.full(n, back))])
    return _pow, _inv


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers: out[e] - out[s] is the hash of buf[s:e] times BASE**s."""
    power, _ = _powers(len(buf) + 1)
    return np.concatenate([[_S(0)], np.cumsum(_BYTE[buf] * power[: len(buf)])])


def segments(raw: list[bytes], length: int = LENGTH, k: int = K) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All segments of some texts: joined bytes, starts of texts, then text, first window, number of windows, anchor hash and anchor place of each."""
    joined = b"".join(raw)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return joined, starts, none, none, none, np.zeros(0, _S), none
    buf = np.frombuffer(joined, np.uint8)
    sums = prefix_hashes(buf)
    grams = len(buf) - k + 1
    h = mix((sums[k : k + grams] - sums[:grams]) * _powers(len(buf) + 1)[1][:grams])
    best = (h & _S(0xFFFFFFFF00000000)) | np.arange(grams, dtype=_S)
    span, width = 1, length - k + 1
    while span < width:  # smallest of `span` neighbours, doubling
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    anchor = (best & _S(0xFFFFFFFF)).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(starts, window, side="right") - 1
    inside = window + length <= (starts + sizes)[text]
    window, text, anchor = window[inside], text[inside], anchor[inside]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(window) else none
    count = np.diff(np.append(new, len(window)))
    return joined, starts, text[new], window[new], count, h[anchor[new]], anchor[new]


def _raw_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = batch.column(column).to_pylist()
    for i, j in blocks(texts, BLOCK):
        yield i, j, [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]


class Marks(NamedTuple):
    """The shape of a packed table of bits for 64-bit hashes: it has 2**bits, made in 2**parts parts."""

    bits: int
    parts: int

    def of(self, hashes: np.ndarray) -> bytes:
        """One part's bits, those of ``hashes`` (all of that part) set."""
        width = 1 << (self.bits - self.parts)
        marks = np.zeros(width, np.uint8)
        marks[((hashes >> _S(64 - self.bits)) & _S(width - 1)).astype(np.int64)] = 1
        return zlib.compress(np.packbits(marks).tobytes(), 1)

    def split(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(part, begin, end) of sorted hashes."""
        part = (hashes >> _S(64 - self.parts)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        yield from zip(part[cut].tolist(), cut.tolist(), np.append(cut[1:], len(hashes))[: len(cut)].tolist(), strict=True)

    def brought(self, parts: DataFrame) -> np.ndarray:
        out = np.zeros((1 << self.parts, 1 << (self.bits - self.parts - 3)), np.uint8)
        for r in parts.toLocalIterator():
            out[r["part"]] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        return out.reshape(-1)


def shape(size: int, length: int, k: int) -> Marks:
    """The shape of tables for the anchors of texts of ``size`` bytes."""
    anchors = 2 * size // (length - k + 1) + 1
    parts = max(PARTS, (anchors * 8 // PART_BYTES).bit_length())
    bits = min(max((16 * anchors).bit_length(), MARKS[0]), MARKS[1])
    return Marks(bits, min(parts, bits - 3))


def shape_for(entries: int) -> Marks:
    """The shape of a table for so many hashes."""
    bits = min(max((16 * entries).bit_length(), MARKS[0]), MARKS[1])
    return Marks(bits, PARTS)


def _pack(part: list, bits: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])


def mark_repeated(docs: DataFrame, marks: Marks, length: int, k: int) -> np.ndarray:
    """The bits of the anchor hashes that occur twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if any(map(len, held)):
                h, n = np.unique(np.concatenate(held), return_counts=True)
                cuts = [*marks.split(h)]
                ones = [h[a:b][n[a:b] == 1].tobytes() for _, a, b in cuts]
                more = [h[a:b][n[a:b] > 1].tobytes() for _, a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cuts], pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], names=["part", "ones", "more"])
                held.clear()

        for batch in batches:
            for _, _, raw in _raw_blocks(batch, 0):
                *_, h, at = segments(raw, length, k)
                held.append(h[np.unique(at, return_index=True)[1]] if len(at) else h)
                if sum(map(len, held)) >= _HELD:
                    yield from flush()
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, ones: list[bytes], more: list[bytes]) -> pa.RecordBatch:
            once, twice = np.frombuffer(b"".join(ones), _S), np.frombuffer(b"".join(more), _S)
            h, n = np.unique(np.concatenate([once, np.unique(twice)]), return_counts=True)
            return _pack([part], [marks.of(np.concatenate([h[n > 1], twice]))])

        part, ones, more = -1, [], []
        for batch in batches:
            for p, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and ones:
                    yield done(part, ones, more)
                    ones, more = [], []
                part = p
                ones.append(x)
                more.append(y)
        if ones:
            yield done(part, ones, more)

    sent = docs.mapInArrow(emit, "part int, ones binary, more binary").repartition("part").sortWithinPartitions("part")
    return marks.brought(sent.mapInArrow(gather, "part int, bits binary"))


def mark_hashes(hashes: DataFrame) -> np.ndarray:
    """The bits of all values (one BIGINT column), in a table of their number's size."""
    marks = shape_for(hashes.count())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_S) for batch in batches]
        if any(map(len, held)):
            h = np.unique(np.concatenate(held))
            for p, a, b in marks.split(h):
                yield _pack([p], [marks.of(h[a:b])])

    return marks.brought(hashes.mapInArrow(emit, "part int, bits binary"))


def _marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> _S(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _sha(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def _heads(shas: list[bytes]) -> np.ndarray:
    """The first 8 bytes of digests as numbers."""
    return np.frombuffer(b"".join(x[:8] for x in shas), ">u8").astype(_S)


def scan_places(docs: DataFrame, bits: Broadcast, length: int, k: int) -> DataFrame:
    """Rows of texts (n_bytes and sha set) and of their marked segments (place set): anchor, digest, place, windows, and the head of the text's sha."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "sha": pa.binary(), "anchor": pa.int64(), "d": pa.int64(), "head": pa.int64(), "place": pa.int32(), "windows": pa.int32()}

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=[*kinds])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw in _raw_blocks(batch, 2):
                joined, starts, text, first, count, h, _ = segments(raw, length, k)
                hit = _marked(bits.value, h)
                text, first, count, h = text[hit], first[hit], count[hit], h[hit]
                digests = [_digest(joined[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                row, doc = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                shas = [_sha(r) for r in raw]
                yield rows(len(raw), row=row, doc_id=doc, n_bytes=[len(r) for r in raw], sha=shas)
                if digests:
                    yield rows(len(text), row=row.take(pa.array(text)), anchor=h.view(np.int64), d=digests, head=_heads(shas).view(np.int64)[text], place=(first - starts[text]).astype(np.int32), windows=count.astype(np.int32))

    return docs.mapInArrow(emit, "row bigint, doc_id bigint, n_bytes bigint, sha binary, anchor bigint, d bigint, head bigint, place int, windows int")


def _pieces(data: bytes, back: int, length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(range of offsets, digest of the core, own digest, first window, place of the anchor, bytes) of a segment's pieces."""
    low = back - (len(data) - length)  # offsets of the windows: from `back` down to this
    for part in range(low // WIDTH, back // WIDTH + 1):
        a, b = back - min(back, part * WIDTH + WIDTH - 1), back - max(low, part * WIDTH)
        piece, at = data[a : b + length], back - a
        core = piece[at - part * WIDTH : at - part * WIDTH - WIDTH + 1 + length]
        yield part, _digest(core), _digest(piece), a, at, piece


def scan_segments(docs: DataFrame, several: Broadcast, chosen: Broadcast, large: Broadcast, length: int, k: int) -> DataFrame:
    """(anchor, part, core, pd, d, at, back, data): segments of anchors with several, each from the texts chosen for it.

    Whole segments have part -1, their digest as ``pd`` and 0 as ``at``; those of large anchors are in pieces.
    """
    names = ["anchor", "part", "core", "pd", "d", "at", "back", "data"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, raw in _raw_blocks(batch, 2):
                joined, _, text, first, count, h, at = segments(raw, length, k)
                heads = _heads([_sha(r) for r in raw])
                out = []
                many = _marked(large.value, h)
                hit = np.flatnonzero(_marked(several.value, h))
                datas = [joined[a : a + n + length - 1] for a, n in zip(first[hit].tolist(), count[hit].tolist(), strict=True)]
                digests = [_digest(x) for x in datas]
                mine = _marked(chosen.value, heads[text[hit]] ^ np.array(digests, np.int64).view(_S))
                for x, data, d, ok in zip(hit.tolist(), datas, digests, mine.tolist(), strict=True):
                    anchor, back = int(h[x].view(np.int64)), int(at[x] - first[x])
                    if not ok or (anchor, d) in sent:
                        continue
                    if len(sent) > 1 << 16:
                        sent.clear()
                    sent.add((anchor, d))
                    if many[x]:
                        out += [(anchor, part, core, pd, d, a, b, piece) for part, core, pd, a, b, piece in _pieces(data, back, length)]
                    else:
                        out.append((anchor, -1, 0, d, d, 0, back, data))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(emit, "anchor bigint, part int, core bigint, pd bigint, d bigint, at int, back int, data binary")


def scan_texts(docs: DataFrame, bits: Broadcast) -> DataFrame:
    """(sha, text): the compressed bytes of texts whose SHA-256 is marked."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw in _raw_blocks(batch, 2):
                shas = [_sha(r) for r in raw]
                hit = np.flatnonzero(_marked(bits.value, _heads(shas))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([shas[x] for x in hit], pa.binary()), pa.array([zlib.compress(raw[x], 3) for x in hit], pa.binary())], names=["sha", "text"])

    return docs.mapInArrow(emit, "sha binary, text binary")


# -- the suffix sort


class Suffixes:
    """Suffixes of one buffer, compared up to ``length`` bytes by their hashes."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = np.concatenate([buf, np.zeros(8, np.uint8)]), length
        self.sums = prefix_hashes(buf)
        self.power = _powers(len(buf) + 1)[0]
        head = np.zeros(len(buf), _S)
        for i in range(8):
            head = (head << _S(8)) | self.buf[i : i + len(buf)].astype(_S)
        self.head = head

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of n bytes at i and at j agree."""
        return (self.sums[i + n] - self.sums[i]) * self.power[j] == (self.sums[j + n] - self.sums[j]) * self.power[i]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions, at most ``length``, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length)
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffix i against suffix j."""
        a, b = self.head[i], self.head[j]
        out = np.where(a < b, -1, 1)
        tie = np.flatnonzero(a == b)
        if len(tie):
            i, j = i[tie], j[tie]
            n = self.common(i, j)
            x, y = self.buf[np.minimum(i + n, len(self.buf) - 1)].astype(np.int16), self.buf[np.minimum(j + n, len(self.buf) - 1)].astype(np.int16)
            out[tie] = np.where(n >= self.length, 0, np.sign(x - y))
        return out

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether ``length`` bytes at i and j are the same, byte by byte."""
        out = np.zeros(len(i), bool)
        reach = np.arange(self.length)
        for s in range(0, len(i), 1 << 14):
            a, b = i[s : s + (1 << 14), None] + reach, j[s : s + (1 << 14), None] + reach
            out[s : s + (1 << 14)] = (self.buf[a] == self.buf[b]).all(1)
        return out


def mergesort(suffixes: Suffixes, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order that sorts suffixes within their buckets (``bucket`` ascending), all merges of a level at once."""
    begin = np.searchsorted(bucket, bucket)
    size = np.searchsorted(bucket, bucket, side="right") - begin
    order = np.arange(len(start))
    rank = order - begin
    width = 1
    while width < size.max(initial=0):
        run = rank // width
        other = (run ^ 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        left, base = run % 2 == 0, low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            c = suffixes.compare(start[order[begin[todo] + mid]], start[order[todo]])
            before = np.where(left[todo], c < 0, c <= 0)
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        to = begin + np.where(low >= base, (run // 2) * 2 * width + rank % width + (low - base), rank)
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
        width *= 2
    return order


def repeated_windows(data: list[bytes], group: np.ndarray, back: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each segment (or piece) the runs (first, last) of its windows that another one of its group holds, too."""
    size = np.array([len(d) for d in data], np.int64)
    count = size - length + 1
    base = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(data)), count)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    offset = back[segment] - window
    order = np.lexsort((segment, offset, group[segment]))
    segment, window, offset = segment[order], window[order], offset[order]
    change = np.concatenate([[True], (group[segment][1:] != group[segment][:-1]) | (offset[1:] != offset[:-1])])
    bucket = np.cumsum(change) - 1
    alone = np.bincount(bucket)[bucket] < 2
    segment, window, bucket = segment[~alone], window[~alone], bucket[~alone]
    runs: list[list[tuple[int, int]]] = [[] for _ in data]
    if not len(segment):
        return runs
    start = base[segment] + window
    suffixes = Suffixes(np.frombuffer(b"".join(data), np.uint8), length)
    order = mergesort(suffixes, start, bucket)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    a, b = a[near], b[near]
    full = np.flatnonzero(suffixes.same(start[a], start[b], np.full(len(a), length)))
    a, b = a[full], b[full]
    sure = suffixes.equal(start[a], start[b])
    hit = np.unique(np.concatenate([a[sure], b[sure]]))
    by = np.lexsort((window[hit], segment[hit]))
    s, w = segment[hit][by], window[hit][by]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)])) if len(s) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(s)) - 1
    for x, f, t in zip(s[new].tolist(), w[new].tolist(), w[last].tolist(), strict=True):
        runs[x].append((f, t))
    return runs


def sorted_segments(data: DataFrame, length: int) -> DataFrame:
    """(anchor, part, core, pd, first, last): repeated windows of segments and pieces (anchor, part, core, pd, back, data)."""
    key = ["anchor", "part", "core"]
    together = data.select(*key, "pd", "back", "data").repartition(*key).sortWithinPartitions(*key, "pd")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, last = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                group = np.cumsum([0] + [x[:3] != y[:3] for x, y in zip(held, held[1:], strict=False)])
                runs = repeated_windows([x[5] for x in held], group, np.array([x[4] for x in held], np.int64), length)
                flat = [(*x[:4], f, t) for x, r in zip(held, runs, strict=True) for f, t in r]
                held.clear()
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=[*key, "pd", "first", "last"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and r[:4] == last:
                    continue  # of another text, too
                if last and r[:3] != last[:3] and windows >= _SORT:
                    yield from done()
                    windows = 0
                last = r[:4]
                held.append(r)
                windows += len(r[5]) - length + 1
        yield from done()

    return together.mapInArrow(run, "anchor bigint, part int, core bigint, pd bigint, first int, last int")


def repeated_runs(sent: DataFrame, length: int) -> DataFrame:
    """(anchor, d, first, last): repeated windows of the segments in ``sent``, a written result of ``scan_segments``."""
    key = ["anchor", "part", "core", "pd"]
    pieces = sent.where("part >= 0")
    each = pieces.groupBy(*key).agg(F.min("d").alias("_a"), F.max("d").alias("_b"), F.first("back").alias("back"), F.first("data").alias("data"))
    each = work.written(each.withColumn("windows", F.length("data") - (length - 1)), "pieces")
    cores = each.groupBy("anchor", "part", "core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = sorted_segments(sent.where("part < 0").select(*key, "back", "data").unionByName(each.join(cores, ["anchor", "part", "core"]).select(*key, "back", "data")), length)
    found = work.written(found, "runs")
    twice = each.where("_a < _b").select(*key, F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    of_pieces = pieces.select(*key, "d", "at").join(twice.unionByName(found.where("part >= 0")), key)
    whole = found.where("part < 0").select("anchor", F.col("pd").alias("d"), "first", "last")
    return whole.unionByName(of_pieces.select("anchor", "d", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, null if all or none remain) per row.

    ``docs`` should be a table or file scan: its texts are scanned four times and never shuffled,
    but for the compressed texts of rows that are cut in part.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = shape(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0, length, k)
    bits = spark.sparkContext.broadcast(mark_repeated(slim.select("text"), marks, length, k))
    scan = work.written(scan_places(slim, bits, length, k), "repeat-scan")
    bits.destroy()
    places = scan.where("place IS NOT NULL").select("row", "anchor", "d", "head", "place", "windows")
    digests = work.written(places.groupBy("anchor", "d").agg(F.count(F.lit(1)).alias("n"), F.min("windows").alias("w"), F.min("head").alias("head")), "digests")
    several = work.written(digests.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    wanted = work.written(digests.join(several.select("anchor"), "anchor").select(F.col("head").bitwiseXOR(F.col("d")).alias("h")), "wanted")
    tables = [spark.sparkContext.broadcast(mark_hashes(x)) for x in (several.select("anchor"), wanted, several.where(F.col("n") > MANY).select("anchor"))]
    sent = work.written(scan_segments(slim, *tables, length, k), "segments")
    for table in tables:
        table.destroy()
    twice = digests.where("n > 1").select("anchor", "d", F.lit(0).alias("first"), (F.col("w") - 1).cast("int").alias("last"))
    repeats = work.written(twice.unionByName(repeated_runs(sent, length)), "repeats")
    met = places.join(repeats, ["anchor", "d"]).select("row", (F.col("place") + F.col("first")).alias("a"), (F.col("place") + F.col("last") + length).alias("b"))
    by_row = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))

    def add(acc, x):
        # ranges in order: sums of the closed runs, and the run that is open
        joins = x["a"] <= acc["end"]
        return F.struct(
            F.when(joins, acc["spans"]).otherwise(F.array_append(acc["spans"], F.struct(acc["begin"].alias("a"), acc["end"].alias("b")))).alias("spans"),
            F.when(joins, acc["begin"]).otherwise(x["a"]).alias("begin"),
            F.when(joins, F.greatest(acc["end"], x["b"])).otherwise(x["b"]).alias("end"),
        )

    head = F.element_at("r", 1)
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("spans"), head["a"].alias("begin"), head["b"].alias("end"))
    spans = F.aggregate("r", start, add, lambda acc: F.array_append(acc["spans"], F.struct(acc["begin"].alias("a"), acc["end"].alias("b"))))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    texts = scan.where("n_bytes IS NOT NULL").select("row", "doc_id", "n_bytes", "sha")
    judged = texts.join(by_row.select("row", spans.alias("spans")), "row", "left").withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("long")))
    judged = work.written(judged.withColumn("n_spans", F.coalesce(F.size(F.col("spans")), F.lit(0)).cast("long")).withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("long"))), "judged")
    part = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes"))
    whole = judged.where(~part).select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") == 0, F.lower(F.hex("sha"))).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))

    head = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long")
    chosen = spark.sparkContext.broadcast(mark_hashes(judged.where(part).select(head.alias("h"))))
    cut_rows = judged.where(part).join(scan_texts(slim, chosen), "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "text", F.transform("spans", lambda r: r["a"]).alias("a"), F.transform("spans", lambda r: r["b"]).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, rest = [], []
            for z, a, b in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True):
                raw = zlib.decompress(z)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
                shas.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shas, pa.string()), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return whole.unionByName(cut_rows.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated 200-byte strings: the digest of what is left."""
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM w WHERE k IN (SELECT k FROM again)),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS f FROM ends),
rest AS (SELECT d.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS x FROM kept JOIN d ON d.doc_id = kept.doc_id GROUP BY d.doc_id),
cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN rest ON rest.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
