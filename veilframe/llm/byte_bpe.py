"""Byte-level BPE, encoded in length-bucketed padded matrices.

Each match of the split pattern is encoded by itself.  Matches that a task meets
for the first time are rows of matrices, one matrix for each class of lengths;
in every round each row merges its leftmost pair of least rank, so that all rows
lose one column together, and finished rows leave.  Ranks of pairs come from an
open-addressing hash table in numpy.
"""

import base64
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
LONG = 512                # bytes; longer matches merge all places of a rank in one round
CACHED = 200_000          # matches whose ids a task remembers
MATRIX_CELLS = 1 << 20


class PairTable:
    """(left id, right id) to a value, by hashing with linear probing; NONE where there is no such pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full((1 << self.bits) + len(keys), -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):                      # of those that want a free slot the first gets it, the others move on
            free = self.keys[slot[rest]] == -1
            _, first = np.unique(slot[rest][free], return_index=True)
            placed = rest[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], value[placed]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] += 1

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Negative ids are padding and form no pairs."""
        keys = self._key(left, right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        rest = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[rest])
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            more = ~hit & (there != -1)
            rest, slot = rest[more], slot[more] + 1
        return out.reshape(left.shape)


class ByteBpe:
    def __init__(self, lines: list[bytes], pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        parts = [b""] * size
        left, right, merged = array("i"), array("i"), array("i")        # a quarter of a million pairs, held as numbers
        for token, rank in self.ranks.items():
            parts[rank] = token
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(*(np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (left, right, merged)))
        self.size = np.array([len(x) for x in parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        self._learn([x for x in set().union(*split) if x not in known])
        none = [np.zeros(0, np.int32)]
        return [np.concatenate([known[x] for x in own] or none) for own in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        size = self.size[ids]
        shift = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.bytes[np.arange(len(shift)) + shift].tobytes()

    def _learn(self, new: list[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for x in new:
            raw = x.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[x] = np.array([rank], np.int32)
            elif len(raw) > LONG:
                self.known[x] = self._merge_long(self.byte[np.frombuffer(raw, np.uint8)])
            else:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((x, raw))
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                for (x, _), ids in zip(part, self._merge([raw for _, raw in part], width)):
                    self.known[x] = ids

    def _merge(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.pairs.look_up(m[:, :-1], m[:, 1:])
        own, out = np.arange(len(rows)), [None] * len(rows)
        while len(own):
            at = ranks.argmin(axis=1)                      # the leftmost of the least
            rank = ranks[np.arange(len(own)), at]
            for i in np.flatnonzero(rank == NONE):
                out[own[i]] = m[i][m[i] >= 0]
            going = rank != NONE
            m, ranks, own, at, rank = m[going], ranks[going], own[going], at[going], rank[going]
            if not len(own):
                break
            row, columns = np.arange(len(own)), np.arange(m.shape[1])
            m[row, at] = rank
            m = m[columns != at[:, None] + 1].reshape(len(own), -1)
            ranks = ranks[columns[:-1] != at[:, None]].reshape(len(own), -1)
            if not m.shape[1] > 1:
                for i in row:
                    out[own[i]] = m[i][m[i] >= 0]
                break
            for shift in (0, 1):                           # the pairs that the new id forms with its neighbours
                has = (at - shift >= 0) & (at - shift < ranks.shape[1])
                r, c = row[has], at[has] - shift
                ranks[r, c] = self.pairs.look_up(m[r, c], m[r, c + 1])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One match.  All places of the least rank merge at once, unless that brings about a pair of lower rank."""
        ranks = self.pairs.look_up(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]     # in a run of overlapping places every second one
            for chosen in (at, at[:1]):
                new = ids.copy()
                new[chosen] = least
                keep = np.ones(len(ids), bool)
                keep[chosen + 1] = False
                new = new[keep]
                after = self.pairs.look_up(new[:-1], new[1:])
                if not (after < least).any():
                    break
            ids, ranks = new, after
        return ids


def _vocabulary(path: str | None) -> list[bytes]:
    """The vocabulary file's lines, read once and sent with the code; such files hold a megabyte."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read().splitlines()


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``ids`` (binary: little-endian unsigned 32-bit ids) and ``decoded`` (the bytes they stand for).

    Null and empty texts have no ids.  ``vocabulary`` is the path of a rank file.
    """
    lines = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    kinds = dict(docs.dtypes)

    def make():
        model = ByteBpe(lines.value, pattern)

        def f(piece):
            texts = [t or "" for t in piece.column("text_").to_pylist()]
            ids = [x for a, z in common.runs([len(t) for t in texts]) for x in model.encode(texts[a:z])]
            return {c: piece.column(c) for c in keep} | {
                "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                "decoded": pa.array([model.decode(x) for x in ids], pa.binary())}
        return f
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text_"))
    return common.map_pieces(texts, "text_", make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids binary, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them, as digests."""
    out = encode(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
