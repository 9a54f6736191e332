"""Whitening of embeddings, fitted on their distinct vectors.

Entries become whole numbers, so equal vectors are equal exactly.  Equal vectors are
grouped before anything else, which counts them in the tasks that read them; the fit
weighs each by one, or by its count.  Sums are exact, matrices of products are taken
about the whole numbers next to the mean and put right for the rest of it, so the
covariance does not depend on how rows are dealt to tasks.  Each distinct vector is
whitened once, and rows look theirs up.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common, vectors as V

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16


@dataclass
class Space:
    """The fit over the vectors of one length: their number, exact sums, whole numbers next to the mean, and what the sums are beyond those."""

    n: int
    sums: list[int]
    centre: np.ndarray
    beyond: list[int]
    axes: np.ndarray | None = None           # one column for each component
    spread: np.ndarray | None = None         # eigenvalues, 0 where there is no variance
    explained: np.ndarray | None = None
    identity_error: float | None = None


def _weights(batch: pa.RecordBatch, at: np.ndarray, once: bool) -> np.ndarray:
    return np.ones(len(at), np.int64) if once else batch.column("weight").to_numpy()[at]


def _sums(found: DataFrame, once: bool) -> dict[int, Space]:
    """Exact sums over the fit list: 2 x length numbers for each task, added up in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, at, x in V.by_length(b.column("x")):
                w = _weights(b, at, once)
                own = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                own[0] += int(w.sum())
                for i, half in enumerate(V.halves(x), 1):
                    own[i] += w @ half
        for d, (n, upper, lower) in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "upper": pa.array([upper], pa.list_(pa.int64())), "lower": pa.array([lower], pa.list_(pa.int64()))})
    parts = found.select("x", "weight").mapInArrow(run, "d int, n bigint, upper array<bigint>, lower array<bigint>")
    whole = parts.select("d", "n", F.posexplode(F.arrays_zip("upper", "lower")).alias("i", "h"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    spaces: dict[int, dict[int, tuple[int, int]]] = {}
    for r in whole.groupBy("d", "i").agg(F.sum("n").alias("n"), total("h.upper").alias("upper"), total("h.lower").alias("lower")).collect():
        spaces.setdefault(r.d, {})[r.i] = (r.n, int(r.upper) * (1 << 32) + int(r.lower))
    out = {}
    for d, own in spaces.items():
        n, sums = own[0][0], [own[i][1] for i in range(d)]
        centre = [(2 * s + n) // (2 * n) for s in sums]
        out[d] = Space(n, sums, np.array(centre, np.int64), [s - n * c for s, c in zip(sums, centre)])
    return out


def _products(rows: DataFrame, column: str, kind: str, matrix: Callable[[int, np.ndarray], np.ndarray], once: bool) -> dict[int, np.ndarray]:
    """For each length the weighted sum of outer products of rows, which ``matrix`` makes: one matrix for each task, added up in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, at, x in V.by_length(b.column(column)):
                y = matrix(d, x)
                held[d] = held.get(d, 0.0) + y.T @ (y * _weights(b, at, once)[:, None])
        for d, m in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "row": pa.array([m[i, :i + 1] for i in range(d)], pa.list_(pa.float64()))})
    parts = rows.select(column, "weight").mapInArrow(run, "d int, i int, row array<double>")
    out: dict[int, np.ndarray] = {}
    for r in parts.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r.d, np.zeros((r.d, r.d)))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return out


def fit(found: DataFrame, components: int = COMPONENTS, once: bool = True) -> dict[int, Space]:
    """One space for each length among the vectors (x, weight); what reaches the driver are sums and matrices, whatever the rows."""
    spaces = _sums(found, once)
    centres = {d: s.centre for d, s in spaces.items()}
    products = _products(found, "x", "bigint", lambda d, x: (x - centres[d]).astype(np.float64), once)
    for d, s in spaces.items():
        mean = np.array([b / s.n for b in s.beyond])
        covariance = products[d] / s.n - np.outer(mean, mean)
        spread, axes = np.linalg.eigh(covariance)
        spread, axes = spread[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        trace = float(np.trace(covariance))
        none = spread <= d * np.finfo(np.float64).eps * max(float(spread[0]), 0.0)
        s.axes, s.spread, s.explained = axes, np.where(none, 0.0, spread), np.where(none, 0.0, spread) / (trace if trace > 0 else 1.0)
    return spaces


def _whiten(spaces: dict[int, Space]):
    """A ``mapInArrow`` function: exact squared deviation and whitened entries of each distinct vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in V.by_length(b.column("x")):
                s = spaces[d]
                from_centre, beyond = x - s.centre, np.array(s.beyond, object)
                most = s.n * V.bound(from_centre) + V.bound(beyond)
                kind = np.int64 if most * most * d < 1 << 63 else object
                scaled = from_centre.astype(kind) * s.n - beyond.astype(kind)          # n * x - S
                deviation = [v if v < 1 << 63 else None for v in (scaled * scaled).sum(axis=1).tolist()]
                entries = (scaled / s.n).astype(np.float64) @ s.axes
                entries /= np.sqrt(np.where(s.spread > 0, s.spread, 1.0))
                lists = entries.tolist() if (s.spread > 0).all() else [[v if e > 0 else None for v, e in zip(row, s.spread)] for row in entries.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "key": b.column("key").take(pa.array(at)), "weight": b.column("weight").take(pa.array(at)), "d": pa.array([d] * len(at), pa.int32()),
                    "deviation": pa.array(deviation, pa.int64()), "whitened": pa.array(lists, pa.list_(pa.float64()))})
    return run


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, once: bool = True) -> DataFrame:
    """The columns of ``rows`` but ``vector``, with ``whitening``: n, deviation, whitened, explained (both by component) and identity_error.

    ``once`` fits on each distinct vector once, otherwise on all rows.  Rows whose
    vector is null or empty, or holds null or non-finite entries, go.  Vectors of
    another length are another space with a fit of its own.
    A component without variance (below the precision of doubles) has null
    ``whitened`` and explains 0.  A ``deviation`` beyond 64 bits is null.  Other
    columns may have any names, and repeated rows stay rows.
    """
    names = [c for c in rows.columns if c != vector]
    kept = rows.where(V.is_vector(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") > 0)).select(*[F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(names)], V.whole(F.col(f"`{vector}`"), SCALE, SHIFT).alias("x"))
    key = lambda x: F.unhex(F.sha2(F.concat_ws(",", x.cast("array<string>")), 256)).alias("key")
    found = common.stage(kept.groupBy("x").agg(F.count("*").alias("weight")).select("x", "weight", key(F.col("x"))), "distinct-vectors")
    spaces = fit(found, components, once)
    done = common.stage(found.mapInArrow(_whiten(spaces), "key binary, weight bigint, d int, deviation bigint, whitened array<double>"), "whitened")
    own = {d: np.flatnonzero(s.spread > 0) for d, s in spaces.items()}
    filled = done.withColumn("filled", F.filter("whitened", lambda v: v.isNotNull())).where(F.size("filled") > 0)
    lengths = {d: len(at) for d, at in own.items() if len(at)}
    for d, size in lengths.items():
        m = _products(filled.where(F.col("d") == d), "filled", "double", lambda _, y: y, once)[size]
        spaces[d].identity_error = float(np.abs(m / spaces[d].n - np.eye(size)).max())
    model = rows.sparkSession.createDataFrame([(d, s.n, s.explained.tolist(), s.identity_error) for d, s in spaces.items()], "length int, n bigint, explained array<double>, identity_error double")
    done = done.join(F.broadcast(model), F.col("d") == F.col("length"))
    done = done.select("key", "weight", F.struct("n", "deviation", "whitened", "explained", "identity_error").alias("whitening"))
    keyed = common.stage(kept.withColumn("key", key(F.col("x"))).drop("x"), "keyed-rows")
    out = common.join_spread(keyed, done, "key", "weight")
    return out.select(*[F.col(f"c{i}__").alias(c) for i, c in enumerate(names)], "whitening")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    out = whiten(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    w = out.select("vec_id", "whitening", F.posexplode("whitening.whitened").alias("i", "whitened"))
    return w.select("vec_id", (F.col("i") + 1).alias("component"), F.col("whitening.n").alias("n"), F.col("whitening.deviation").alias("deviation"), "whitened",
                    F.element_at("whitening.explained", F.col("i") + 1).alias("explained"), F.col("whitening.identity_error").alias("identity_error"))
