import random
import re

import pytest

from veilframe.llm import repeats
from veilframe.llm.repeats import WINDOW, remove_repeats


def brute(docs):
    """Rows (doc_id, text) to (doc_id, words, removed, kept text); rows that repeat both are one document."""
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in docs}
    seen, out = set(), {}
    for d in sorted(split, key=lambda d: (d[0] is None, d[0] or 0)):
        w, gone = split[d], set()
        for i in range(len(w) - WINDOW + 1):
            g = tuple(w[i:i + WINDOW])
            if g in seen:
                gone.update(range(i, i + WINDOW))
            seen.add(g)
        out[d] = (d[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return sorted((out[d] for d in docs), key=str)


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as doc", "1 as th", "2 as at", "'y' as n_words").repartition(parts)
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [["a", "b"], ["a"], ["a", "b", "c", "d"], ["a", "é", "😀x"], list("abcdefghijklmnopqrstuvwxyz"), ["a"] * 30 + ["b", "c"]][seed]
    say = lambda n: [rng.choice(vocabulary) + (str(rng.randrange(50)) if seed in (2, 4) else "") for _ in range(n)]
    passages = [say(rng.choice([19, 20, 21, 25, 40, 70])) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(30)) for _ in range(rng.randrange(4))] + rng.sample(passages, rng.randrange(4))
        rng.shuffle(parts)
        docs.append((i * 3 - 20, rng.choice([" ", "\n", " \t ", " "]).join(x for p in parts for x in p) + rng.choice(["", " "])))
    docs += [(1000 + i, docs[i % 7][1]) for i in range(15)] + docs[:3]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, docs[0][1]), (2000, None)]
    assert run(spark, docs) == brute(docs)


def test_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    docs = []
    for i in range(50):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    assert run(spark, docs, 8) == brute(docs)


def test_rows_settled_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 1)
    docs = [(i, " ".join("abcdefghijklmnopqrstuvwxyz"[i % 3:])) for i in range(9)]
    assert run(spark, docs, 2) == brute(docs)


def test_no_rows_and_long_text(spark):
    assert run(spark, []) == []
    long = " ".join(str(i % 5000) for i in range(120_000))
    assert run(spark, [(1, long)]) == brute([(1, long)])
