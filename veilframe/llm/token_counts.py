"""Token counts of a word-level BPE by rank-synchronous merging of ragged arrays.

The symbols of all new pre-tokens of a batch lie end to end in one array.  In
each round every pre-token merges all places of its own lowest-rank pair, and the
array is compacted; what is left are the tokens, which are only counted.
"""

import json
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common
from veilframe.llm.byte_bpe import NONE, PairTable

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHED = 400_000          # pre-tokens whose counts a task remembers


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be seen, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


class Counter:
    """Reads what it needs from a tokenizer file: vocabulary, merges, word-end mark, split pattern and special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, vocabulary = spec["model"], spec["model"]["vocab"]
        letters, end = _byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = ([vocabulary[m[i]] for m in merges] for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable(np.array(left, np.int32), np.array(right, np.int32), np.arange(len(merges), dtype=np.int32))
        born = {int(x): i for i, x in reversed(list(enumerate(self.merged)))}
        if any(born.get(x, -1) >= i for i, pair in enumerate(zip(left, right)) for x in pair):
            raise ValueError("a merge comes before those that make its parts; ranks could not be merged together")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern).findall
        self.space = regex.compile(r"\p{White_Space}+").sub
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Special strings inside a text are one token each, and what lies between them is normalised by itself."""
        if len(self.known) > CACHED:
            self.known = {}
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special and "<" in text else [text]
            split.append([x for part in parts for x in self.split(self._normal(part))])
            extra.append(len(parts) - 1)
        known = self.known
        self._learn([x for x in set().union(*split) if x not in known])
        return [n + sum(map(known.__getitem__, own)) for own, n in zip(split, extra)]

    def _normal(self, text: str) -> str:
        text = self.space(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()       # letter by letter: no other form at the end of a word

    def _learn(self, new: list[str]) -> None:
        raw = [x.encode() for x in new]
        sizes = np.array([len(x) for x in raw], np.int64)
        if not len(raw):
            return
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        counts = np.ones(len(raw), np.int64)
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1][inside] = self.pairs.look_up(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            done = least == NONE
            counts[owner[first[done]]] = size[done]
            if done.all():
                break
            least = np.repeat(least, size)
            at = np.flatnonzero((rank == least) & (least != NONE))
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]     # of overlapping places every second one
            symbols[at] = self.merged[rank[at]]
            keep = least != NONE
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        self.known.update(zip(new, counts.tolist()))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``n_bytes`` and ``n_tokens``; null and empty texts have none."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        text = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = dict(docs.dtypes)

    def make():
        model = Counter(text.value)

        def f(piece):
            return {c: piece.column(c) for c in keep} | {
                "n_bytes": piece.column("n_bytes"),
                "n_tokens": pa.array(model.count([t or "" for t in piece.column("text_").to_pylist()]), pa.int64())}
        return f
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text_"),
                        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"))
    return common.map_pieces(texts, "text_", make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_bytes bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed the context length."""
    out = count_tokens(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
