"""Toxicity by maximum-scoring segments of token log-odds.

Words get log-odds of occurring in toxic against clean texts, with a Dirichlet
prior in proportion to their overall frequency.  A word whose lower bound is high
enough scores that bound, any other word a small penalty.  A linear scan finds all
maximal scoring segments of a text.  Extreme-value statistics turn the scores of
segments into evidence that allows for the length of the text and the number of
segments; a logistic curve turns that evidence into a score.

Words are learned from three quarters of the labelled rows, the curve from the rest.
"""

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veilframe.llm import common, words as W
from veilframe.llm.language import held_out

LEARN = 12_000            # labelled rows of each label that are learned from, chosen by a hash of their id
PRIOR, FLOOR = 500.0, 0.5 # size of the Dirichlet prior, and what it gives to the rarest word
BOUND, LEAST = 2.5, 1.0   # standard deviations below the log-odds, and what must be left of them
PENALTY = 0.1             # nats for a word without evidence
HASHES, SHINGLE = 4, 3     # texts of one label that share one of so many min-hashes teach once
WORDS = 100_000           # at most so many words score, those with the most evidence
FILTER_BITS = 1 << 23
STEP, LOW, HIGH = 0.25, -20.0, 200.0      # evidence is rounded to this grid before the curve is fitted
THRESHOLD = 0.7


def segments(scores: list[float], at: list[int], penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score) of a text.

    ``at`` and ``scores`` are the places and scores of its positive words; every
    other word costs ``penalty``.  Linear time: each segment links to the nearest
    one before it that starts lower, and merged segments leave the list.
    """
    found: list[tuple[int, int, float, float, int]] = []      # first, end, sum before, sum after, link
    total, before = 0.0, None
    for p, s in zip(at, scores):
        if before is not None:
            total -= penalty * (p - before - 1)
        first, low, total, before = p, total, total + s, p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, low = found[j][0], found[j][2]             # the segment grows back to that one
            del found[j:]
        found.append((first, p + 1, low, total, j))
    return [(a, z, high - low) for a, z, low, high, _ in found]


class Model:
    """Scores of words by hash, and the constants of the extreme-value distribution and the curve."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]
        self.filter = np.zeros(FILTER_BITS, bool)
        self.filter[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.rate, self.scale, self.curve = 1.0, 1.0, (0.0, 0.0)

    def passages(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        w = W.words(texts, W.ALNUM, W.LOWER)
        h = w.hashes()
        at = np.flatnonzero(self.filter[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
        place = np.searchsorted(self.hashes, h[at])
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == h[at[known]]
        at, place = at[known], place[known]
        text = np.searchsorted(w.first, at, "right") - 1
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        scores, local = self.scores[place].tolist(), (at - w.first[text]).tolist()
        return w.counts, [segments(scores[a:z], local[a:z]) if z > a else [] for a, z in zip(bounds.tolist(), bounds[1:].tolist())]

    def evidence(self, n_words: int, found: list[tuple[int, int, float]]) -> float:
        """The largest sum statistic of the r best segments, over all r: how far their scores exceed what chance brings about."""
        best, total = LOW, 0.0
        allowance = log(max(1.0, self.scale * max(1, n_words)))
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            total += self.rate * s - allowance
            best = max(best, total + lgamma(r + 1))
        return min(max(best, LOW), HIGH)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fit) of about LEARN rows of each label; ``fit`` marks the quarter that the curve is fitted to."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic"), F.lit(min(1.0, LEARN / max(1, counts.get(True, 0))))).otherwise(F.lit(min(1.0, LEARN / max(1, counts.get(False, 0)))))
    chance = lambda seed: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.where(chance(3) < share).select("doc_id", "toxic", (chance(4) < 0.25).alias("fit"))
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    texts = common.with_row_id(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fit"))      # about 2 * LEARN rows

    def make():
        def f(piece):
            w = W.words(piece.column("text"), W.ALNUM, W.LOWER)
            shingles = W.grams(w.hashes(), SHINGLE)
            least = []
            for a, z in zip(w.first, w.first[1:]):
                own = shingles[a:max(a, z - SHINGLE + 1)]
                least.append([int((own * m).min().view(np.int64)) for m in W.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)] if len(own) else None)
            return {c: piece.column(c) for c in ("uid", "text", "toxic", "fit")} | {"least": pa.array(least, pa.list_(pa.int64()))}
        return f
    sample = common.stage(common.map_pieces(texts.select("uid", "text", "toxic", "fit"), "text", make, "uid bigint, text string, toxic boolean, fit boolean, least array<bigint>"), "toxic-sample")
    once = sample.where("least is not null").select("uid", "toxic", "least")
    for i in range(HASHES):
        order = Window.partitionBy("toxic", F.get("least", F.lit(i))).orderBy("uid")
        once = once.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return sample.select("uid", "text", "toxic", "fit").join(once.select("uid"), "uid", "left_semi")


def _word_scores(sample: DataFrame) -> Model:
    """Scores of words, each counted once a text, and the rate that belongs to them."""
    def make():
        def f(piece):
            w = W.words(piece.column("text"), W.ALNUM, W.LOWER)
            toxic = np.array(piece.column("toxic").to_pylist(), bool)
            pair = np.unique(np.stack([w.text_of().astype(np.uint64), w.hashes()]), axis=1) if len(w.start) else np.zeros((2, 0), np.uint64)
            h, which = np.unique(pair[1], return_inverse=True)
            bad = toxic[pair[0].astype(np.int64)]
            return {"h": pa.array(h.view(np.int64)), "bad": pa.array(np.bincount(which, bad, len(h)).astype(np.int64)),
                    "good": pa.array(np.bincount(which, ~bad, len(h)).astype(np.int64))}
        return f
    counts = common.stage(common.map_pieces(sample, "text", make, "h bigint, bad bigint, good bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-words")
    all_bad, all_good = (float(x or 0) for x in counts.agg(F.sum("bad"), F.sum("good")).first())
    every = max(1.0, all_bad + all_good)
    prior = (F.col("bad") + F.col("good")) * (PRIOR / every) + FLOOR
    odds = lambda n, total: F.log((n + prior) / (total + PRIOR - n - prior))
    spread = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    bound = odds(F.col("bad"), F.lit(all_bad)) - odds(F.col("good"), F.lit(all_good)) - BOUND * spread
    chosen = counts.select("h", "good", bound.alias("s")).where(F.col("s") >= LEAST).orderBy(F.desc("s"), "h").limit(WORDS).collect()
    model = Model(np.array([r["h"] for r in chosen], np.int64).view(np.uint64), np.array([r["s"] for r in chosen], np.float64))
    model.rate = _rate([((r["good"] + 0.5) / max(1.0, all_good), r["s"]) for r in chosen])
    return model


def _rate(positive: list[tuple[float, float]]) -> float:
    """The rate of the extreme-value distribution: where the mean of exp(rate * score) over clean words is one."""
    p, s = np.array(positive or [(0.0, 1.0)]).T
    rest = max(1e-9, 1 - p.sum())
    mean = lambda x: rest * np.exp(-x * PENALTY) + (p * np.exp(x * s)).sum() - 1
    if (p * s).sum() >= rest * PENALTY or not positive:
        return 1.0 if not positive else 0.05
    low, high = 0.0, 1.0
    while mean(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return float(high)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that ``labels`` (doc_id, toxic) teach; rows without a label or id teach nothing, and of several labels the largest holds."""
    sample = _labelled(docs, labels)
    model = _word_scores(sample.where("not fit"))

    def make():
        def f(piece):
            n, found = model.passages(piece.column("text"))
            return {"toxic": piece.column("toxic"), "n_words": pa.array(n, pa.int64()),
                    "scores": pa.array([[s for _, _, s in x] for x in found], pa.list_(pa.float64()))}
        return f
    scored = common.stage(common.map_pieces(sample.where("fit"), "text", make, "toxic boolean, n_words bigint, scores array<double>"), "toxic-segments")
    seen = scored.where("not toxic").agg(F.sum(F.size("scores")).alias("n"), F.sum("n_words").alias("words")).first()
    model.scale = max(1.0, seen["n"] or 0.0) / max(1.0, float(seen["words"] or 0))     # chance segments for each word

    def evidence():
        def f(piece):
            rows = zip(piece.column("n_words").to_pylist(), piece.column("scores").to_pylist())
            x = np.array([model.evidence(n, [(0, 0, s) for s in scores]) for n, scores in rows])
            return {"toxic": piece.column("toxic"), "x": pa.array(np.rint(x / STEP).astype(np.int64))}
        return f
    grid = common.map_pieces(scored.withColumn("pad", F.lit(" " * 64)), "pad", evidence, "toxic boolean, x bigint")
    rows = grid.groupBy("x", "toxic").count().collect()                               # at most two for each step of the grid
    model.curve = _logistic([(r["x"] * STEP, r["toxic"], r["count"]) for r in rows])
    return model


def _logistic(points: list[tuple[float, bool, int]]) -> tuple[float, float]:
    """Intercept and slope (not below zero) by Newton's method with a weak prior."""
    if not any(t for _, t, _ in points) or all(t for _, t, _ in points):
        return (-2.0, 0.5)
    x, y, n = (np.array(c, np.float64) for c in zip(*points))
    n = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum()) * n.sum() / 2       # both labels weigh the same
    a, b = 0.0, 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n * (y - p)).sum() - 0.01 * a, (n * (y - p) * x).sum() - 0.01 * b])
        v = n * p * (1 - p)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), max(1e-3, b + float(np.clip(step[1], -1, 1)))
    return a, b


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``score`` (0 to 1) and ``passages`` (first word, word after the last, score, expected number by chance).

    Null and empty texts have no passages and the least score.
    """
    kinds = dict(docs.dtypes)

    def make():
        def f(piece):
            n, found = model.passages(piece.column("text_"))
            values = model.score(np.array([model.evidence(int(c), x) for c, x in zip(n, found)]))
            out = [[{"first": a, "end": z, "score": s, "expected": float(model.scale * c * np.exp(-model.rate * s))} for a, z, s in x] for c, x in zip(n, found)]
            return {c: piece.column(c) for c in keep} | {"score": pa.array(np.round(values, 6), pa.float64()), "passages": pa.array(out, pa.list_(
                pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])))}
        return f
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text_"))
    return common.map_pieces(texts, "text_", make, ", ".join(f"`{c}` {kinds[c]}" for c in keep)
                             + ", score double, passages array<struct<first: int, end: int, score: double, expected: double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by what the labels of the other two thirds teach."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.read(spark, sf_dir, "labels", "doc_id", "toxic")
    out = score(docs, learn(docs, labels.where(~held_out("doc_id", 3, 1))))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.size("passages").alias("n_passages"))
