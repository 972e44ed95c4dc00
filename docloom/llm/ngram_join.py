"""N-gram Jaccard self-join with token-combination prefixes.

Two documents link when the Jaccard similarity t of their sets of word shingles ("tokens" here)
reaches a threshold. A set of n tokens may lose n - ceil(t*n) of them and still link.

1. One scan gives each document's set size and a 128-bit key of its set; documents of equal sets are
   one *group* from here on. The scan also counts tokens in a table of 2**COUNTERS counters (a count
   is never too low). Tokens above the table's background level are *hot*; the table of hot classes
   is the only thing broadcast, and hot tokens are never shuffled by themselves.
2. A second scan sends the first tokens (by hash) that are not hot, half as many again as a set may
   lose. Linked sets have several of them in common, so groups that share too few are dropped: what
   remains are the near copies and little else. Lists of one token are no longer than the level.
3. The remaining whole sets are written, and the documents that hold a token are counted *exactly*
   among them. A token that no other set holds is a loss already: a set with too many is dropped.
4. The tokens that others hold are ordered by class and count, rarest first. Rare tokens are
   signatures by themselves (k = 1); of more frequent classes k-token combinations are, k growing
   with the class: tokens are dealt to groups by hash (their number follows the set size;
   neighbouring size bands share a dealing), and a group with m of them in the prefix yields its
   k-combinations and is lost with m - k + 1 losses only. The prefix is extended until its losses
   exceed what the set can bear. Linked sets then share a signature: take the one whose prefix ends
   first; what it loses to the other cannot cover all its groups, and what remains of one lies in
   the other's prefix as well.
5. Sets that meet can link only if the tokens from the first common signature on suffice (c - p of c
   held tokens, p before it that can't be shared); linked sets pass this where they meet first, so
   every other meeting is dropped before anything is fetched. One round compares each list's members with its
   best member (fewest tokens of its own) and joins what links into components; a second one
   compares what is still in different components. Both verify on the whole sets.
6. Components are labelled by their smallest doc_id.

Tokens and sets are known by hashes: 64 bits a token, 128 bits a set (64 between steps 2 and 6).

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer words
than n make one shingle of the whole sequence; repeated rows are documents of their own and link;
very long texts are treated whole; a null doc_id takes part and is never a component's name unless
all its members' are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import work
from docloom.llm.components import connected
from docloom.llm.shingles import blocks, mix, shingle_sets
from docloom.shipping import ship
from docloom.staging import spread

#: Bits of the number of counters (fixed size, whatever the input).
COUNTERS = 23
#: Tokens held by at most so many of the remaining sets are signatures alone, in pairs; beyond it k is 3.
CLASSES = (32, 1 << 14)
_SLICE = 1 << 16
#: Tokens a task holds before it sends them on, and bytes of tokens for a task that receives them.
_HELD = 1 << 20
_PART_BYTES = 16 << 20
#: Bytes a token takes there: its hash and its set's.
_TOKEN = 16
#: Sets whose ids are marked in a bit table (16 bits each); more are found by a join.
MARKED = 1 << 22
#: Counts above this are not told apart; hot classes come after them.
_MOST = 65535
_S = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[str | None]]]:
    texts = batch.column(1).to_pylist()
    for i, j in blocks(texts):
        yield slice(i, j), texts[i:j]


def _set_keys(hashes: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and both halves of the key of each set."""
    n = np.bincount(owner, minlength=rows)
    ends = np.cumsum(n)
    keys = []
    for salt in (0x51ED270B, 0x7FEB352D):
        total = np.concatenate([[_S(0)], np.cumsum(mix(hashes + _S(salt)))])
        keys.append(mix(total[ends] - total[ends - n] + n.astype(_S)))
    return n, keys[0], keys[1]


def _batch(schema: dict[str, pa.DataType], rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in schema.items()], names=[*schema])


def _packed(values: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive pieces of ``values``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)])


# -- tables of counters, added up in slices


def _slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for s in range(0, len(counts), _SLICE):
        part = counts[s : s + _SLICE]
        if part.any():
            yield s // _SLICE, zlib.compress(np.minimum(part.astype(np.int64), 65535).astype(np.uint16).tobytes(), 1)


def _added(df: DataFrame, finish, width: int) -> np.ndarray:
    """Sum (slice, blob) rows, apply ``finish`` to each sum and bring the ``width`` bytes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.uint16)
                if s in sums:
                    sums[s] += part
                else:
                    sums[s] = part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([zlib.compress(finish(v).astype(np.uint8).tobytes(), 1) for v in sums.values()], pa.binary())], names=["slice", "blob"])

    out = np.zeros(width, np.uint8)
    for r in df.repartition("slice").mapInArrow(run, "slice int, blob binary").toLocalIterator():
        got = np.frombuffer(zlib.decompress(r["blob"]), np.uint8)
        out[r["slice"] * _SLICE : r["slice"] * _SLICE + len(got)] = got
    return out


_SCAN = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "slice": pa.int32(), "blob": pa.binary()}


def scan_sets(docs: DataFrame, n: int, counters: int = COUNTERS) -> DataFrame:
    """Rows (doc_id, text_hash, n, k1, k2) of the documents, and rows (slice, blob) of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << counters, np.int32)
        for batch in batches:
            for at, texts in _texts(batch):
                hashes, owner = shingle_sets(texts, n)
                np.add.at(counts, (hashes & _S((1 << counters) - 1)).astype(np.int64), 1)
                size, k1, k2 = _set_keys(hashes, owner, len(texts))
                ids, th = (batch.column(c).slice(at.start, len(texts)) for c in (0, 2))
                yield _batch(_SCAN, len(texts), doc_id=ids, text_hash=th, n=size, k1=k1.view(np.int64), k2=k2.view(np.int64))
        for s, blob in _slices(counts):
            yield _batch(_SCAN, 1, slice=[s], blob=[blob])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, k1 bigint, k2 bigint, slice int, blob binary")


def _level(tokens: int, counters: int = COUNTERS) -> float:
    """The counts above which a token is hot: the mean and what it varies by."""
    mean = tokens / (1 << counters)
    return mean + 6 * mean**0.5 + 16


def hot_classes(slices: DataFrame, tokens: int, counters: int = COUNTERS) -> np.ndarray:
    """The class of every counter: 0 up to the level, then one more for each doubling."""
    level = _level(tokens, counters)
    return _added(slices, lambda v: np.where(v <= level, 0, 1 + np.floor(np.log2(np.maximum(v, 1) / level))), 1 << counters)


# -- sets that may link at all


def _losses(n, num: int, den: int):
    """How many of n tokens a set may lose and still link."""
    return n - -(-num * n // den)


def _parts(spark: SparkSession, tokens: int) -> int:
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens * _TOKEN // _PART_BYTES))


def _by_part(hashes: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of the parts that hashes belong to, and each one's hashes followed by their ids."""
    part = (mix(hashes) % _S(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    hashes, ids, part = hashes[order], ids[order], part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cut[1:], len(part))[: len(cut)]
    return part[cut], [np.concatenate([hashes[a:b], ids[a:b]]).tobytes() for a, b in zip(cut, ends, strict=True)]


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(b, _S) for b in blobs]
    none = [np.zeros(0, _S)]
    return np.concatenate(none + [b[: len(b) // 2] for b in both]), np.concatenate(none + [b[len(b) // 2 :] for b in both])


_PREFIX = {"part": pa.int32(), "blob": pa.binary(), "id": pa.int64(), "cold": pa.int32()}


def shared_prefixes(docs: DataFrame, table: Broadcast, parts: int, n: int, num: int, den: int) -> DataFrame:
    """(id, shared, cold): of a prefix of tokens that are not hot, how many another set's prefix has, too.

    ``cold`` is set for sets that have fewer such tokens than the prefix should: it holds them all.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                part, blobs = _by_part(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)
                held.clear()
                yield _batch(_PREFIX, len(part), part=part, blob=blobs)

        for batch in batches:
            for _, texts in _texts(batch):
                hashes, owner = shingle_sets(texts, n)
                size, k1, _ = _set_keys(hashes, owner, len(texts))
                may = size * (den - num) >= num  # else no other set is similar enough
                new = np.zeros(len(texts), bool)
                new[np.unique(k1, return_index=True)[1]] = True
                new &= may
                new[new] = [k not in seen for k in k1[new].tolist()]  # copies in one task are sent once
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.update(k1[new].tolist())
                lose = _losses(size, num, den)
                full = 1 + lose + lose // 2
                cold = new[owner] & (table.value[(hashes & _S(len(table.value) - 1)).astype(np.int64)] == 0)
                hashes, owner = hashes[cold], owner[cold]
                count = np.bincount(owner, minlength=len(texts))
                first = (np.arange(len(hashes)) - (np.cumsum(count) - count)[owner]) < full[owner]
                held.append((hashes[first], k1[owner[first]]))
                few = np.flatnonzero(new & (count < full))
                if len(few):
                    yield _batch(_PREFIX, len(few), part=(mix(k1[few]) % _S(parts)).astype(np.int32), id=k1[few].view(np.int64), cold=count[few])
                if sum(len(x[0]) for x in held) >= _HELD:
                    yield from flush()
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            few = batch.filter(batch.column(2).is_valid())
            if len(few):
                yield pa.RecordBatch.from_arrays([few.column(2), pa.array(np.zeros(len(few), np.int64)), few.column(3)], names=["id", "shared", "cold"])
            blobs += batch.column(1).drop_null().to_pylist()
        sig, ids = _unpacked(blobs)
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        if len(sig):
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
            sig, ids = sig[new], ids[new]
            same = sig[1:] == sig[:-1]
            met, shared = np.unique(ids[np.concatenate([same, [False]]) | np.concatenate([[False], same])], return_counts=True)
            for s in range(0, len(met), 1 << 16):
                e = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([_signed(met[e]), pa.array(shared[e].astype(np.int64)), pa.nulls(len(met[e]), pa.int32())], names=["id", "shared", "cold"])

    sent = docs.mapInArrow(emit, "part int, blob binary, id bigint, cold int").repartitionById(parts, "part")
    return sent.mapInArrow(gather, "id bigint, shared bigint, cold int").groupBy("id").agg(F.sum("shared").alias("shared"), F.max("cold").alias("cold"))


def may_link(prefixes: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, first_id) of the groups that share enough of their prefixes.

    Of two linked sets, the one whose prefix ends first has 1 + losses // 2 of it in common with the
    other's; it has t*n tokens at least. A set that has sent all its tokens but the hot ones may
    share hot ones only, but can't have lost more than it may.
    """
    smaller = f"((n * {num} + {den - 1}) div {den})"
    least = f"1 + (({smaller} - ({smaller} * {num} + {den - 1}) div {den}) div 2)"
    enough = f"shared >= {least} OR cold - shared <= n - {smaller}"
    met = prefixes.join(groups.select(F.col("k1").alias("id"), "n", "first_id"), "id").where(enough)
    return met.groupBy("id").agg(F.max("n").alias("n"), F.min("first_id").alias("first_id"))


# -- whole sets of these


def _bit(ids: np.ndarray, width: int) -> np.ndarray:
    return (mix(ids.view(_S)) & _S(width - 1)).astype(np.int64)


def mark_ids(ids: DataFrame, bits: int) -> np.ndarray:
    """A packed table in which the bit of every id is set (others may be, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            marks[_bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), len(marks))] = 1
        for s, blob in _slices(marks):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names=["slice", "blob"])

    return np.packbits(_added(ids.mapInArrow(run, "slice int, blob binary"), lambda v: v > 0, 1 << bits))


def scan_chosen(docs: DataFrame, bits: Broadcast | None, n: int) -> DataFrame:
    """(id, set) of the documents whose doc_id is marked in ``bits`` (of all where there is no table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                at = _bit(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), 8 * len(bits.value))
                batch = batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))
            for _, texts in _texts(batch):
                hashes, owner = shingle_sets(texts, n)
                size, k1, _ = _set_keys(hashes, owner, len(texts))
                yield pa.RecordBatch.from_arrays([_signed(k1), _packed(hashes.tobytes(), np.cumsum(size) * 8)], names=["id", "set"])

    return docs.mapInArrow(run, "id bigint, set binary")


def holders(sets: DataFrame, table: Broadcast, parts: int) -> DataFrame:
    """(id, codes): how many of ``sets`` (id, set) hold each of a set's tokens that are not hot.

    Codes are 16-bit counts in the order of the tokens' parts, then hashes, an array element a part.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                part, blobs = _by_part(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in batches:
            for i, data in zip(batch.column(0).to_numpy().astype(np.int64).view(_S), batch.column(1), strict=True):
                tokens = np.frombuffer(data.as_buffer(), _S)
                tokens = tokens[table.value[(tokens & _S(len(table.value) - 1)).astype(np.int64)] == 0]
                held.append((tokens, np.full(len(tokens), i)))
            if sum(len(x[0]) for x in held) >= _HELD:
                yield from flush()
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = _unpacked([b for batch in batches for b in batch.column(1).to_pylist()])
        if not len(tokens):
            return
        order = np.argsort(tokens, kind="stable")
        tokens, ids = tokens[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(starts, len(tokens)))
        codes = np.repeat(np.minimum(count, _MOST), count).astype(np.uint16)
        part = (mix(tokens) % _S(parts)).astype(np.int32)
        order = np.lexsort((tokens, ids, part))
        ids, part, codes = ids[order], part[order], codes[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(first[1:], len(ids))
        for s in range(0, len(first), 1 << 16):
            a, b = first[s : s + (1 << 16)], ends[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([_signed(ids[a]), pa.array(part[a]), _packed(codes[a[0] : b[-1]].tobytes(), 2 * (b - a[0]))], names=["id", "part", "codes"])

    sent = sets.select("id", "set").mapInArrow(emit, "part int, blob binary").repartitionById(parts, "part")
    each = sent.mapInArrow(gather, "id bigint, part int, codes binary")
    in_order = F.array_sort(F.collect_list(F.struct("part", "codes")))
    return each.groupBy("id").agg(in_order.alias("c")).select("id", F.transform("c", lambda x: x["codes"]).alias("codes"))


# -- signatures


def _dealt(tokens: np.ndarray, band: int, groups: int) -> np.ndarray:
    return (mix(tokens ^ _S((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _S(groups)).astype(np.int64)


def _combinations(tokens: np.ndarray, ks: np.ndarray, bear: int, band: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-token combinations of a prefix of ``tokens`` (classes in order) that is lost with over ``bear`` losses only.

    With each comes how many tokens before its first one another set can't share if it shares no
    combination that begins earlier: all but k - 1 of every group.
    """
    group = _dealt(tokens, band, groups)
    _, at = np.unique(group + groups * ks, return_index=True)
    free = np.zeros(len(tokens), np.int64)
    free[at] = ks[at] - 1
    before = np.maximum(np.arange(len(tokens)) - (np.cumsum(free) - free), 0)
    out, places = [np.zeros(0, _S)], [np.zeros(0, np.int64)]
    for k in np.unique(ks):
        mine = np.flatnonzero(ks == k)
        by = np.argsort(group[mine], kind="stable")
        place = np.empty(len(mine), np.int64)
        place[by] = np.arange(len(mine)) - np.searchsorted(group[mine][by], group[mine][by])
        adds = np.cumsum(place >= k - 1)  # from the k-th on, each token of a group has to be lost as well
        length = int(np.searchsorted(adds, bear + 1)) + 1
        mine = mine[:length]
        for g in np.unique(group[mine]):
            of_group = mine[group[mine] == g]
            if len(of_group) >= k:
                chosen = of_group[np.array([*combinations(range(len(of_group)), int(k))])]
                sig = np.full(len(chosen), _S(band * 8 + int(k)))
                for column in chosen.T:
                    sig = mix(sig * _S(3) + tokens[column])
                out.append(sig)
                places.append(before[chosen[:, 0]])
        if length <= len(adds):
            break
        bear -= int(adds[-1])
    return np.concatenate(out), np.concatenate(places)


def signatures_of(tokens: np.ndarray, count: np.ndarray, ks: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of tokens of a set that others hold, its signatures, how many held tokens before each a set that meets it there first can't share, and whether it is of the set's own size band.

    ``count`` orders the tokens within their class ``ks``; 1 means that no other set holds it. A set
    that has lost too many already has no signatures.
    """
    n, alive = len(tokens), np.flatnonzero(count >= 2)
    need = -(-num * n // den)
    bear = len(alive) - need
    if bear < 0 or n * (den - num) < num:
        return len(alive), np.zeros(0, _S), np.zeros(0, np.int64), np.zeros(0, bool)
    alive = alive[np.lexsort((tokens[alive], count[alive], ks[alive]))]
    tokens, ks = tokens[alive], ks[alive]
    rare = int((ks == 1).sum())
    sigs = [tokens[: min(bear + 1, rare)]]
    places, own = [np.arange(len(sigs[0]))], [np.ones(len(sigs[0]), bool)]
    if rare <= bear:
        base = log(den / num) * 1.000001
        band = floor(log(n) / base)
        for b in (band, band + 1):
            groups = max(1, int((1 - num / den) / 3 * np.exp(b * base)))
            sig, place = _combinations(tokens[rare:], ks[rare:], bear - rare, b, groups)
            sigs.append(sig)
            places.append(rare + place)
            own.append(np.full(len(sig), b == band))
    return len(alive), np.concatenate(sigs), np.concatenate(places), np.concatenate(own)


def signatures(sets: DataFrame, counted: DataFrame, table: Broadcast, level: float, parts: int, num: int, den: int) -> DataFrame:
    """(sig, id, n, c, p, own) of ``sets`` (id, set), the last three as in ``signatures_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def made() -> Iterator[pa.RecordBatch]:
            if out:
                sig, ids, n, c, p, own = (np.concatenate(x) for x in zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([_signed(sig), _signed(ids), *(pa.array(x.astype(np.int32)) for x in (n, c, p)), pa.array(own)], names=["sig", "id", "n", "c", "p", "own"])

        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64).view(_S)
            for i, data, codes in zip(ids, batch.column(1), batch.column(2).to_pylist(), strict=True):
                tokens = np.frombuffer(data.as_buffer(), _S)
                hot = table.value[(tokens & _S(len(table.value) - 1)).astype(np.int64)].astype(np.int64)
                cold = np.flatnonzero(hot == 0)
                count = _MOST + hot
                order = np.argsort((mix(tokens[cold]) % _S(parts)), kind="stable")
                count[cold[order]] = np.frombuffer(b"".join(codes or ()), np.uint16)
                about = np.where(hot > 0, np.maximum(level * 2.0 ** (hot - 1), CLASSES[0] + 1), count)
                ks = 1 + np.searchsorted(CLASSES, about, side="left")
                c, sig, p, own = signatures_of(tokens, count, ks, num, den)
                if len(sig):
                    out.append((sig, np.full(len(sig), i), np.full(len(sig), len(tokens)), np.full(len(sig), c), p, own))
            yield from made()

    return sets.join(counted, "id", "left").select("id", "set", "codes").mapInArrow(run, "sig bigint, id bigint, n int, c int, p int, own boolean")


# -- verification


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _S), np.frombuffer(y.as_buffer(), _S)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok.append(den * both >= num * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    # b is found in the bucketed sets; the sets of a are fewer, and where one is asked for often Spark splits its rows
    held = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    leaders = work.written(sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id").select(F.col("id").alias("a"), F.col("set").alias("x")), "leader-sets")
    joined = held.join(leaders, "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _suffices(left: tuple[Column, Column], right: tuple[Column, Column], num: int, den: int) -> Column:
    """Whether (n, tokens from the signature on) of two sets are enough for a link."""
    return F.least(left[1], right[1]) * (num + den) >= (left[0] + right[0]) * num


def link_groups(sigs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, comp) of the sets that link with another one; ``sigs`` has (sig, id, n, c, p, own)."""
    sigs = sigs.withColumn("left", F.col("c") - F.col("p"))
    mine = (F.col("n"), F.col("left"))
    best = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), F.xxhash64("id").alias("h"), "id", "n", "left")).alias("l")
    lead = sigs.groupBy("sig").agg(best).select("sig", F.col("l.id").alias("_id"), F.col("l.n").alias("_n"), F.col("l.left").alias("_left"))
    theirs = (F.col("_n"), F.col("_left"))
    met = sigs.join(lead, "sig").where((F.col("id") != F.col("_id")) & _suffices(mine, theirs, num, den))
    pairs = work.written(met.select(F.col("_id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    labels = connected(work.written(verified(pairs, sets, num, den), "links"))
    # what is still in different components: of every list, the sets outside its best one's component against all
    held = work.written(sigs.join(labels, "id", "left").select("sig", "id", "n", "left", "own", (F.col("c") / F.col("n")).alias("share"), F.coalesce("comp", "id").alias("comp")), "held")
    lists = held.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.min("n").alias("_least"), F.max(F.struct("share", F.xxhash64("id").alias("h"), "comp")).alias("_top"))
    lists = lists.where("_a < _b").select("sig", "_least", F.col("_top.comp").alias("top"))
    open_ = work.written(held.join(lists, "sig").where(F.col("left") * (num + den) >= (F.col("n") + F.col("_least")) * num).select("sig", "id", "n", "left", "own", "comp", "top"), "open")
    other = open_.select("sig", F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("left").alias("_left"), F.col("own").alias("_own"), F.col("comp").alias("_comp"))
    # sets of one band meet in its dealing: in the next band's they need not be looked at again
    once = (F.col("own") | F.col("_own")) & ((F.col("_comp") == F.col("top")) | (F.col("id") < F.col("_id")))
    both = open_.where("comp <> top").join(other, "sig").where((F.col("comp") != F.col("_comp")) & once & _suffices(mine, theirs, num, den))
    more = work.written(both.select(F.col("_id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = work.written(verified(more, sets, num, den), "links")
    if links.isEmpty():
        return labels
    return connected(links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))))


def components(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, k1, k2), and groups (k1, k2, comp, component_id) of those with words."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    scan = work.written(scan_sets(slim, n), "sets-scan")
    rows = scan.where("slice IS NULL").select("doc_id", "text_hash", "n", "k1", "k2")
    groups = work.written(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first_id")), "set-groups")
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    table = spark.sparkContext.broadcast(hot_classes(scan.where("slice IS NOT NULL").select("slice", "blob"), tokens))
    slim = slim.select("doc_id", "text")
    prefixes = shared_prefixes(slim, table, _parts(spark, 3 * tokens * (den - num) // (2 * den)), n, num, den)
    chosen = work.written(may_link(prefixes, groups, num, den), "may-link")
    count, left = chosen.agg(F.count(F.lit(1)), F.sum("n")).first()
    alone = groups.select("k1", "k2", F.col("k1").alias("comp"), F.col("first_id").alias("component_id"))
    if not count:
        return rows, alone
    names, bits = chosen.select(F.coalesce("first_id", F.lit(-1)).alias("first_id")), None
    if count > MARKED:
        slim = slim.join(names.distinct(), F.coalesce("doc_id", F.lit(-1)) == F.col("first_id"), "left_semi")
    else:
        bits = spark.sparkContext.broadcast(mark_ids(names, max(17, (16 * count).bit_length())))
    sets = scan_chosen(slim, bits, n).dropDuplicates(["id"]).join(chosen.select("id"), "id", "left_semi")
    sets = work.bucketed(sets, "sets", "id", dealt=True)
    parts = _parts(spark, left)
    counted = holders(sets, table, parts)
    sigs = work.written(signatures(sets, counted, table, _level(tokens), parts, num, den), "signatures")
    for used in (table, bits):
        if used is not None:
            used.destroy()
    labels = link_groups(sigs, sets, num, den)
    linked = work.written(groups.join(labels, F.col("k1") == F.col("id")).select("k1", "k2", "comp", "first_id"), "linked")
    names = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = linked.select("k1", "k2", F.col("comp").alias("_comp")).join(names.withColumnsRenamed({"comp": "_comp", "component_id": "_id"}), "_comp")
    both = alone.join(named, ["k1", "k2"], "left")
    met = F.col("_comp").isNotNull()
    return rows, work.written(both.select("k1", "k2", *(F.when(met, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_comp", "comp"), ("_id", "component_id")))), "group-components")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: sets link at Jaccard >= num/den.

    ``docs`` should be a table or file scan: it is scanned three times.
    """
    rows, groups = components(docs, n, num, den, id_col, text_col)
    filled = rows.where("n > 0").join(groups.select("k1", "k2", "component_id"), ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, one of the smallest doc_id; rows without words all stay."""
    rows, groups = components(docs, n, num, den, id_col, text_col)
    first = rows.where("n > 0").join(groups, ["k1", "k2"]).where("doc_id <=> component_id")
    best = first.groupBy("comp", F.col("doc_id").alias("_id")).agg(F.min("text_hash").alias("_hash")).select("_id", "_hash", F.lit(False).alias("_blank"))
    blank = rows.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(True).alias("_blank")).distinct()
    keyed = docs.withColumns({"_docloom_id": F.col(id_col).cast("long"), "_docloom_hash": F.xxhash64(F.col(text_col).cast("string"))})
    same = F.col("_docloom_id").eqNullSafe(F.col("_id")) & (F.col("_docloom_hash") == F.col("_hash"))
    nth = F.row_number().over(Window.partitionBy("_docloom_id", "_docloom_hash").orderBy(F.lit(1)))
    kept = keyed.join(best.unionByName(blank), same).withColumn("_nth", nth).where("_blank OR _nth = 1")
    return kept.drop("_docloom_id", "_docloom_hash", "_id", "_hash", "_blank", "_nth")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: sets of 4-word shingles, links at Jaccard >= 0.85."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), n=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY ALL
"""
