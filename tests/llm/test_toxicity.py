import random

import pytest

from veilframe.llm.toxicity import PENALTY, learn, score, segments


def brute(values):
    """Maximal scoring segments by definition: the best segment first, then the same left and right of it."""
    sums = [0.0]
    for v in values:
        sums.append(sums[-1] + v)
    best = max(((round(sums[z] - sums[a], 9), a - z, -a) for a in range(len(values)) for z in range(a + 1, len(values) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    z = a - best[1]
    left = brute(values[:a])
    return left + [(a, z, best[0])] + [(x + z, y + z, s) for x, y, s in brute(values[z:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    values = [rng.choice([0.37, 0.53, 0.91]) if rng.random() < 0.3 else -PENALTY for _ in range(rng.randrange(40))]
    at = [i for i, v in enumerate(values) if v > 0]
    got = [(a, z, round(s, 6)) for a, z, s in segments([values[i] for i in at], at)]
    assert got == [(a, z, round(s, 6)) for a, z, s in brute(values)]


def test_many_segments_take_linear_time():
    n = 200_000
    assert len(segments([1.0] * n, [20 * i for i in range(n)])) == n
    assert len(segments([1.0] * n, [2 * i for i in range(n)])) == 1


def test_held_out_rows_and_odd_rows(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    bad = ["zork", "quux", "blarg"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 0
        text = rng.choices(plain, k=rng.randrange(10, 80))
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(toxic)))
    odd = [(None, None), (5000, ""), (5001, None), (5002, "zork " * 40000), (5002, "zork"), (5003, " ".join(plain) * 50)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic", "2 as uid")
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int").selectExpr("*", "9 as text")
    model = learn(docs, table.where("doc_id % 3 <> 1 or doc_id is null"))
    out = score(docs, model).collect()
    tested = [r for r in out if r.doc_id is not None and r.doc_id < 1200 and r.doc_id % 3 == 1]
    assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in tested)
    least = min(r.score for r in out)
    assert all(r.score == least and r.passages == [] for r in out if r.doc_id in (None, 5000, 5001, 5003))
    assert sorted(len(r.passages) for r in out if r.doc_id == 5002) == [1, 1] and all(r.score >= 0.7 for r in out if r.doc_id == 5002)
    assert score(docs.where("false"), model).count() == 0
    none = learn(docs, table.where("false"))
    assert {r.score for r in score(docs, none).collect()} == {score(docs.limit(1), none).first().score}
