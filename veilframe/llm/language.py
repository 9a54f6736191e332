"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A gram of three symbols binds its
letters' vectors, each permuted by its place, by multiplication; a text bundles
its grams by addition; a language's prototype bundles the unit vectors of its
texts.  Texts go to the prototype with the largest cosine.  Grams are counted
before they are bundled, so the work for a text follows its distinct grams.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.llm import common

SIZE = 1024               # of the vectors
SYMBOLS = 1024            # letters below U+0250 have a vector of their own, others share the rest
SHARPNESS = 25.0          # from differences of cosines to scores
UNKNOWN = "und"
ENOUGH = 30               # learning texts from whose spread it is told what is too far from a language; with fewer nothing is
UNIT = 1 << 30            # sums of rounded multiples of this do not depend on their order


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all symbols, and the symbol of each code point (0 if it is no letter)."""
    random = np.random.Generator(np.random.Philox(11))
    vectors = random.integers(0, 2, (SYMBOLS, SIZE), dtype=np.int8) * np.int8(2) - np.int8(1)
    code = np.arange(0x110000)
    symbol = np.where(code < 0x250, code, 0x250 + code % (SYMBOLS - 0x250)).astype(np.int64)
    symbol[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 0
    return vectors, symbol


def profiles(texts: list[str | None]) -> np.ndarray:
    """One unit vector for each text; all zeros without a letter."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for a, z in common.runs([len(t or "") for t in texts]):
        out[a:z] = _profiles(texts[a:z])
    return out


def _profiles(texts: list[str | None]) -> np.ndarray:
    vectors, symbol = _letters()
    lowered = ["".join(("\n", (t or "").lower(), "\n")) for t in texts]
    codes = symbol[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])      # one blank between words
    codes, owner = codes[keep], owner[keep]
    out = np.zeros((len(texts), SIZE), np.float32)
    if len(codes) < 3:
        return out
    inside = (owner[:-2] == owner[2:]) & ((codes[:-2] | codes[1:-1] | codes[2:]) != 0)
    key = ((owner[:-2] << 30) | (codes[:-2] << 20) | (codes[1:-1] << 10) | codes[2:])[inside]
    key, counts = np.unique(key, return_counts=True)
    gram, where = np.unique(key & ((1 << 30) - 1), return_inverse=True)
    bound = np.roll(vectors, 2, 1)[gram >> 20]              # a byte a number: the largest table here, of all grams of the texts
    bound *= np.roll(vectors, 1, 1)[(gram >> 10) & 1023]
    bound *= vectors[gram & 1023]
    first = np.searchsorted(key >> 30, np.arange(len(texts) + 1))
    counts = counts.astype(np.float32)
    for t, (a, z) in enumerate(zip(first, first[1:])):
        if z > a:
            v = counts[a:z] @ bound[where[a:z]].astype(np.float32)
            out[t] = v / max(float(np.linalg.norm(v)), 1e-9)
    return out


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def learn(labelled: DataFrame, spread: bool = False) -> tuple[list[str], np.ndarray, np.ndarray | None]:
    """Languages and prototypes from all rows with text and lang.  With ``spread`` also the least cosines."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text")

    def make():
        def f(piece):
            own = profiles(piece.column("text").to_pylist()).astype(np.float64)
            langs, which = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
            sums = [np.rint(own[which == i] * UNIT).sum(axis=0).astype(np.int64) for i in range(len(langs))]
            return {"lang": pa.array(langs.tolist(), pa.string()), "v": pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))}
        return f
    parts = common.map_pieces(labelled, "text", make, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()      # a row for each language
    if not rows:
        return [], np.zeros((0, SIZE), np.float32), None
    v = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), SIZE)
    names, norms = [r["lang"] for r in rows], np.maximum(np.linalg.norm(v, axis=1), 1e-9)
    prototypes = (v / norms[:, None]).astype(np.float32)
    return names, prototypes, _least(labelled, names, prototypes, norms / UNIT) if spread else None


def _least(labelled: DataFrame, names: list[str], prototypes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The least cosine of a text that fits a language: a standard deviation below the least of its learning texts.

    Each learning text is held against what the others bundle to; ``norms`` are
    those of the sums of unit vectors.
    """
    place = {g: i for i, g in enumerate(names)}

    def make():
        def f(piece):
            v = profiles(piece.column("text").to_pylist())
            lang = np.array([place[g] for g in piece.column("lang").to_pylist()], np.int64)
            dot = (v * prototypes[lang]).sum(axis=1).astype(np.float64) * norms[lang]
            others = np.sqrt(np.maximum(norms[lang] ** 2 - 2 * dot + 1, 0))
            own = (v != 0).any(axis=1) & (others > 0.5)
            return {"lang": pa.array(lang[own]), "x": pa.array(np.round((dot - 1)[own] / others[own], 6))}
        return f
    cosines = common.map_pieces(labelled, "text", make, "lang bigint, x double")
    least = np.full(len(names), -np.inf)
    for r in cosines.groupBy("lang").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.stddev_pop("x").alias("by")).where(F.col("n") >= ENOUGH).collect():
        least[r["lang"]] = r["x"] - r["by"]
    return least


def identify(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...] = ("doc_id",), spread: bool = False) -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score``; with ``spread`` also ``fits``.

    ``score`` is the share of the best language among all that are learned; ``fits``
    tells whether the text is about as close to the best one as its learning texts
    are, whatever other languages are close, too.
    Only the text decides.  Null and letterless texts are ``und`` with score 0, as
    are all texts if there is nothing to learn from.
    """
    names, prototypes, least = learn(labelled, spread)
    kinds = dict(docs.dtypes)

    def make():
        def f(piece):
            v = profiles(piece.column("text_").to_pylist())
            known = (v != 0).any(axis=1) & bool(names)
            cosine = v @ prototypes.T if names else np.zeros((len(v), 1))
            best = cosine.argmax(axis=1)
            weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
            score = np.where(known, 1 / weight.sum(axis=1), 0.0)
            fits = known if least is None else known & (cosine.max(axis=1) >= least[best])
            return {"fits": pa.array(fits)} | {c: piece.column(c) for c in keep} | {
                "lang_pred": pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                "score": pc.round(pa.array(score, pa.float64()), 6)}
        return f
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text_"))
    return common.map_pieces(texts, "text_", make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double" + ", fits boolean" * spread)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs, docs.where(~held_out("doc_id", 5, 0)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
