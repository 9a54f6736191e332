import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import common, whitening as M


def brute(vectors, once=True, components=M.COMPONENTS):
    """For each vector that is one: (n, deviation, whitened or None for each component, explained), by whole numbers and one matrix."""
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in kept]
    out = []
    for d in {len(x) for x in whole}:
        fitted = [x for x in whole if len(x) == d]
        fitted = sorted(set(fitted)) if once else fitted
        n, sums = len(fitted), [sum(x[i] for x in fitted) for i in range(d)]
        centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fitted]).reshape(n, d)
        e, u = np.linalg.eigh(centred.T @ centred / n)
        total, e, u = max(e.sum(), 1e-300), e[::-1][:components], u[:, ::-1][:, :components]
        for x in [x for x in whole if len(x) == d]:
            y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
            out.append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), [abs(float(y @ u[:, i])) / e[i] ** 0.5 if e[i] > 1e-9 else None for i in range(len(e))], [max(v, 0.0) / total for v in e]))
    return out


def run(spark, vectors, **options):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("*", "'a' as key", "1 as x", "map(1, 2) as weight", "'b' as whitening_").repartition(3)
    out = M.whiten(df, **options)
    assert out.columns == ["vec_id", "key", "x", "weight", "whitening_", "whitening"]
    return [r.whitening for r in out.orderBy("vec_id").collect()]


def agree(got, wanted):
    assert len(got) == len(wanted)
    for g, (n, deviation, whitened, explained) in zip(got, wanted):
        assert (g.n, g.deviation) == (n, deviation)
        assert g.explained == pytest.approx(explained, rel=1e-9, abs=1e-12)
        assert [v is None for v in g.whitened] == [v is None for v in whitened]
        assert [abs(v) for v in g.whitened if v is not None] == pytest.approx([v for v in whitened if v is not None], rel=1e-6, abs=1e-7)
        assert g.identity_error is None or g.identity_error < 1e-9


def vectors(seed, rows, d):
    rng = np.random.Generator(np.random.Philox(seed))
    x = (rng.normal(size=(rows, d)) * np.linspace(3, 0.5, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return x.astype(np.float32).tolist()


@pytest.mark.parametrize("once", (True, False))
def test_agrees_with_brute_force(spark, once):
    x = vectors(1, 60, 24)
    x = x + x[:5] * 30 + x[7:9]                                   # copies, one vector has most rows
    agree(run(spark, x, once=once), brute(x, once))


def test_vectors_that_are_none(spark):
    x = vectors(2, 30, 5)
    broken = [None, [None] * 5, [0.1, float("nan"), 0.0, 0.0, 0.0], [0.1, float("inf"), 0.0, 0.0, 0.0], [-float("inf")] * 5]
    agree(run(spark, x[:9] + broken + x[9:]), brute(x))


def test_without_variance_and_empty(spark):
    assert run(spark, []) == [] and run(spark, [None]) == []
    same = run(spark, [[0.5, -0.01]] * 4)
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, [None, None], [0.0, 0.0], None)] * 4
    assert run(spark, [[], []]) == []
    flat = [[c, 1.0, 2 * c] for c in (0.0, 1.0, 2.5, 4.0)]          # one component has all variance
    got = run(spark, flat)
    agree(got, brute(flat))
    assert got[0].identity_error < 1e-9 and got[0].explained == [pytest.approx(1.0), 0.0, 0.0]


def test_each_length_is_a_space_of_its_own(spark):
    x, y = vectors(3, 20, 4), vectors(4, 20, 6)
    agree(run(spark, x), brute(x))
    both = run(spark, x + y)
    agree(both[:20], brute(x))
    agree(both[20:], brute(y))


def test_numbers_near_the_limits(spark):
    large = [[float(c)] for c in (0, 1e5, -1e5, 2.0 ** 22)]
    agree(run(spark, large), brute(large))
    beyond = run(spark, [[3e38], [-3e38], [1.0]])
    assert [r.deviation for r in beyond] == [None, None, 128 ** 2] and all(abs(r.whitened[0]) < 2 for r in beyond)


def test_cut_into_tasks_at_random_it_is_the_same(spark):
    x = vectors(5, 400, 8)
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    results = {tuple(sorted((r.vec_id, *r.whitening.whitened) for r in M.whiten(df.repartition(p)).collect())) for p in (1, 3)}
    assert len(results) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = M.op11_embedding_whitening(spark, sf).orderBy("vec_id", "component").collect()
    source = common.read(spark, sf, "embeddings", "vec_id", "embedding").orderBy("vec_id").collect()
    wanted = brute([r.embedding for r in source])
    assert len(rows) == 16 * len(source) and {r.identity_error for r in rows}.pop() < 1e-4
    for i, (n, deviation, whitened, explained) in enumerate(wanted):
        own = rows[16 * i:16 * i + 16]
        assert [(r.vec_id, r.component, r.n, r.deviation) for r in own] == [(source[i].vec_id, c + 1, n, deviation) for c in range(16)]
        assert [abs(r.whitened) for r in own] == pytest.approx(whitened, abs=1e-6) and [r.explained for r in own] == pytest.approx(explained, rel=1e-9)
