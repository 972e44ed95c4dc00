"""SentencePiece (BPE, byte fallback) encoding with seeded merge dropout, and lossless decoding.

The model file gives the pieces and their scores. A text is cut into units that no piece crosses (a
run of spaces and what follows it up to the next space or line end); all units of a block of texts are
encoded together. Every unit has an agenda of candidate merges ordered by score, leftmost
first among equals. A candidate whose keyed hash of (seed, document, copy, occurrence, unit, place,
merged piece) falls under the dropout is skipped; the best of the others is taken, its neighbours become candidates, and
so on until the agenda is empty. One numpy round pops one merge of every unit that still has one.

Every occurrence of a unit in a document and every copy of a document draws for itself; reruns, other
batch sizes and other partitionings give the same ids. Rows of one document id draw alike unless a
column tells copies apart. Dropout 0 is the plain SentencePiece encoding.

Defined results: null and empty texts give no ids and decode to an empty text; a literal U+2581 and
characters without a piece go through byte pieces, so decode(encode(t)) == t for every text; a null
document id is hashed as text "null"; columns of the input other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shipping import ship
from docloom.staging import spread

SEED = 1
DROPOUT = 0.1
#: Bytes of text that are encoded together.
BLOCK = 1 << 20

SPACE = "▁"
_NONE = np.int32((1 << 31) - 1)
#: Bits of the number of slots in the table of pairs.
_SLOTS = 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def model_path() -> str:
    """The public BPE model of the machine's tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def key_of(doc_id: object, copy: object, seed: int) -> int:
    import xxhash

    name = "null" if doc_id is None else str(doc_id)
    return xxhash.xxh64_intdigest(name if copy is None else f"{name}/{copy}", seed=seed)


def unit_starts(points: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where units begin: with a text, a line end, after a line end, or with a run of spaces."""
    line, space = points == ord("\n"), points == ord(" ")
    first = line.copy()
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    first[text_at[text_at < len(points)]] = True
    return np.flatnonzero(first)


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(pieces)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append(b"" if i in special else p.replace(SPACE, " ").encode())
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        order = np.unique(np.array([-sp.get_score(i) for i in range(len(pieces))]), return_inverse=True)[1]
        self.symbol = (-np.arange(0x110000) - 1).astype(np.int32)
        for p, i in ids.items():
            if len(p) == 1 and p != SPACE:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = ids[SPACE]
        self.n = len(pieces)
        pairs = sorted((ids[p[:k]] * self.n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_to = np.array([i for _, i in pairs], np.int32)
        self.rank = order.astype(np.int32)
        # the first pair of each slot is found there, the others by binary search
        slot, first, count = np.unique(self._slot(self.pair_key), return_index=True, return_counts=True)
        self.slot_key, self.slot_to, self.slot_more = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, bool)
        self.slot_key[slot], self.slot_to[slot], self.slot_more[slot] = self.pair_key[first], self.pair_to[first], count > 1

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _M1) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _candidates(self, left: np.ndarray, right: np.ndarray, unit: np.ndarray, at: np.ndarray, key: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged piece of each pair; its unit's key and its place say which candidate it is."""
        wanted = left.astype(np.int64) * self.n + right
        wanted[(left < 0) | (right < 0)] = -2
        slot = self._slot(wanted)
        ok, to = self.slot_key[slot] == wanted, self.slot_to[slot]
        other = np.flatnonzero(~ok & self.slot_more[slot])
        if len(other):
            found = np.minimum(np.searchsorted(self.pair_key, wanted[other]), len(self.pair_key) - 1)
            ok[other], to[other] = self.pair_key[found] == wanted[other], self.pair_to[found]
        rank = np.full(len(to), _NONE)
        some = np.flatnonzero(ok)
        if limit:
            draw = _mix(key[unit[some]] + (at[some].astype(np.uint64) * np.uint64(self.n) + to[some].astype(np.uint64) + np.uint64(1)) * _M1)
            some = some[draw >= limit]
        rank[some] = self.rank[to[some]]
        return rank, to

    def encode_units(self, points: np.ndarray, start: np.ndarray, salt: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that begin at ``start``, one after the other, and their offsets; each draws under its salt."""
        unit = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(points))))
        sym = self.symbol[points]
        place = (np.arange(len(points)) - start[unit]).astype(np.int32)
        name = np.add.reduceat(_mix(points.astype(np.uint64) * _M1 + place.astype(np.uint64) + np.uint64(1)), start) if len(start) else np.zeros(0, np.uint64)
        key = _mix(name + salt)
        limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))

        rank, to = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        same = np.flatnonzero(unit[:-1] == unit[1:])
        rank[same], to[same] = self._candidates(sym[same], sym[same + 1], unit[same], place[same], key, limit)
        ended = [(sym[:0], unit[:0], place[:0])]
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            live = np.repeat(best < _NONE, size)
            if not live.all():
                over = ~live
                ended.append((sym[over], unit[over], place[over]))
                sym, unit, place, rank, to = sym[live], unit[live], place[live], rank[live], to[live]
                best, size = best[best < _NONE], size[best < _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.concatenate([[True], unit[hit][1:] != unit[hit][:-1]])]  # the leftmost of each unit
            sym[hit] = to[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            now = hit - np.arange(len(hit))  # one symbol of each earlier unit is gone
            sym, unit, place, rank, to = sym[stay], unit[stay], place[stay], rank[stay], to[stay]
            again = np.zeros(len(sym), bool)
            again[now] = True
            again[now[now > 0] - 1] = True
            redo = np.flatnonzero(again)
            rank[now] = _NONE
            redo = redo[redo + 1 < len(sym)]
            redo = redo[unit[redo] == unit[redo + 1]]
            rank[redo], to[redo] = self._candidates(sym[redo], sym[redo + 1], unit[redo], place[redo], key, limit)
        sym, unit, place = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(unit.astype(np.int64) * len(points) + place, kind="stable")  # merges what each round ended
        sym, unit = sym[order], unit[order]
        if (odd := sym < 0).any():  # bytes in place of characters without a piece
            widths = np.ones(len(sym), np.int64)
            raw = [chr(-int(s) - 1).encode("utf-8", "surrogatepass") for s in sym[odd]]
            widths[odd] = [len(r) for r in raw]
            first = np.cumsum(widths) - widths
            out = np.repeat(sym, widths)
            at = np.repeat(first[odd], widths[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, unit = out, np.repeat(unit, widths)
        return sym.astype(np.int32), np.searchsorted(unit, np.arange(len(start) + 1))

    def encode(self, texts: list[str], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> list[np.ndarray]:
        """The ids of every text; each draws under its key."""
        spaced = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
        text_at = np.cumsum([0, *map(len, spaced)])
        start = unit_starts(points, text_at)
        first = np.searchsorted(start, text_at)  # unit of each text
        n = np.diff(first)
        occurrence = np.arange(len(start)) - np.repeat(first[:-1], n)
        text = _mix(np.array(keys, np.uint64) * _M3 + np.uint64(seed))
        ids, at = self.encode_units(points, start, _mix(np.repeat(text, n) + occurrence.astype(np.uint64) * _M2), dropout)
        return np.split(ids, at[first[1:-1]]) if texts else []

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text that was encoded."""
        got = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return got[1:].decode("utf-8", "surrogatepass") if got else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file, one for each Python worker."""
    return Codec(path)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about BLOCK bytes of text."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, lossless (the decoded ids equal the text) for every row."""
    ship(docs.sparkSession)
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            doc_ids, texts, copies = (c.to_pylist() for c in batch.columns)
            for i, j in _blocks(texts):
                part = [t or "" for t in texts[i:j]]
                ids = c.encode(part, [key_of(d, x, seed) for d, x in zip(doc_ids[i:j], copies[i:j], strict=True)], dropout, seed)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = pa.array(np.concatenate(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64())
                same = pa.array([c.decode(x) == t for x, t in zip(ids, part, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(n), size, same], names=["doc_id", "ids", "n_tokens", "n_bytes", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    copy = F.col(copy_col) if copy_col else F.lit(None)
    return docs.select(id_col, text_col, copy.cast("string").alias("_copy")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, n_bytes bigint, lossless boolean")


def decode_documents(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from rows of ids."""
    ship(encoded.sparkSession)
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with merge dropout and decoded again."""
    return encode_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
