import hashlib
import math
import random

import numpy as np
import pytest

from veilframe.llm import vector_codes as C


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) by plain loops; all vectors have one length."""
    kept = [(i, lab, [math.floor(1024 * c) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    d = len(kept[0][2])
    cut = np.cumsum([0] + [d // 4 + (p < d % 4) for p in range(4)]).tolist()
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    books = [[v[a:z] for _, _, v in kept[:entries]] for a, z in zip(cut, cut[1:])]
    nearest = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, z) in enumerate(zip(cut, cut[1:])):
            members = {}
            for _, _, v in kept:
                members.setdefault(nearest(books[p], v[a:z])[1], []).append(v[a:z])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, lab, v in kept:
        found = [nearest(books[p], v[a:z]) for p, (a, z) in enumerate(zip(cut, cut[1:]))]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    return sorted(((i, lab, code, error, sums[lab], sha) for i, lab, code, error in out), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'a' as v", "1 as d", "map(1, 2) as code", "3 as n").repartition(3)
    out, _ = C.compress(df, **options)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def table(seed, n, d, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(9)]
    rows = [(i * 5 % 10007, rng.choice([None, *range(labels)]), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(n)]
    return rows


@pytest.mark.parametrize("entries,d", ((16, 8), (256, 12)))
def test_agrees_with_brute_force(spark, entries, d):
    rows = table(entries, 400, d)
    rows += [(3, 1, rows[0][2]), (3, 1, rows[0][2]), (3, None, rows[1][2]), (None, 2, rows[2][2])]                         # repeated ids, and none
    rows += [(9000 + i, 0, rows[5][2]) for i in range(200)]                                                                  # one vector has a third of all rows
    broken = [(1, 1, None), (2, 1, [None] * d), (0, 0, [float("nan")] * d), (4, 0, [float("-inf")] * d)]
    assert run(spark, rows + broken, entries=entries) == brute(rows, entries)


def test_few_rows_and_odd_lengths(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []
    for d in (1, 3, 6):
        rows = table(d, 20, d)
        assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, 1, []), (2, None, [])]) == brute([(1, 1, []), (2, None, [])])


def test_each_length_has_codebooks_of_its_own(spark):
    a, b = table(1, 40, 8), [(i + 20000, lab, v) for i, lab, v in table(2, 40, 4)]
    got = run(spark, a + b, entries=8)
    without = lambda rows: [r[:4] + r[5:] for r in rows]
    assert without(got) == sorted(without(brute(a, 8)) + without(brute(b, 8)), key=str)


def test_grids_full_of_ties(spark):
    rows = [(i, i % 2, [float(x) / 1024 for x in ((i * 7) % 3, (i * 5) % 3, i % 2, (i // 2) % 2)]) for i in range(300)]
    assert run(spark, rows, entries=40) == brute(rows, 40)


def test_large_numbers(spark):
    rows = [(i, None, [10.0 ** (i % 12), -(3.0 ** i), 1e9 + i, 0.5]) for i in range(30)]
    held = lambda rows: sorted(((i, lab, code, *[x if x < 1 << 63 else None for x in (error, total)], sha) for i, lab, code, error, total, sha in rows), key=str)
    assert run(spark, rows, entries=9) == held(brute(rows, 9))
    assert [r[3] for r in run(spark, [(1, 1, [1e300]), (2, 1, [-1e300]), (3, 1, [0.0])], entries=1, rounds=0)] == [0, None, None]


@pytest.mark.parametrize("spread", (1, 40, 3000, 1 << 29, 1 << 40))
def test_tree_finds_the_first_of_the_nearest(spread):
    rng = np.random.Generator(np.random.Philox(spread))
    centres = rng.integers(-20 * spread, 20 * spread, (7, 5))
    points = lambda n: centres[rng.integers(0, 7, n)] + rng.integers(-spread, spread + 1, (n, 5))
    entries, queries = points(200), points(500)
    entries[50:60] = entries[:10]
    far = ((queries[:, None, :].astype(object) - entries[None, :, :].astype(object)) ** 2).sum(axis=2)
    index, best, counted = C.Tree(entries).nearest(queries)
    assert (index == far.argmin(axis=1)).all() and [int(b) for b in best] == far.min(axis=1).tolist()
    assert counted < 0.7 * far.size                                             # whole subtrees are left out


def test_a_tree_of_equal_entries():
    index, best, _ = C.Tree(np.zeros((100, 3), np.int64)).nearest(np.array([[1, 2, 2]]))
    assert index.tolist() == [0] and best.tolist() == [9]
