import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontaminate as module
from veilframe.llm.decontaminate import decontaminate, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for _, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, said in items:
            b = words(said)
            k = min(10, len(b))
            grams = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if b else set()
            found = [i for i in range(len(w) - k + 1) if k and tuple(w[i:i + k]) in grams]
            hit.update(p for i in found for p in range(i, i + k))
            if found and item is not None:
                ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, uid string")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, text2 string")
    rows = decontaminate(d, b).select("doc_id", "n_words", "n_hit", "items").collect()
    clean = without_contaminated(d, b)
    assert clean.columns == d.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if not r[2])
    return sorted(((r[0] is None, r[0], r[1], r[2], tuple(r[3])) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ça", "d4", "ÉÉ", "Z"] if seed else ["a", "b"]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(3, say(12)), (None, say(11)), (99, None), (98, "!!")]
    docs = [(i, say(rng.randrange(60))) for i in range(25)]
    docs += [(i + 100, say(5) + " " + items[i][1] + " " + say(5)) for i in range(12)]
    docs += [(None, say(40)), (7, None), (7, ""), (8, say(3000)), (8, say(3000))]
    expected = sorted(((d[0] is None, d[0], n, h, tuple(x)) for d, (n, h, x) in zip(docs, brute(docs, items))), key=str)
    assert run(spark, docs, items) == expected


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(False, 1, 3, 0, ())]


def test_string_ids(spark):
    d = spark.createDataFrame([("k", "one two three")], "doc_id string, text string")
    b = spark.createDataFrame([("i", "TWO, three")], "item_id string, text string")
    row = decontaminate(d, b).select("doc_id", "n_hit", F.concat_ws(",", "items")).first()
    assert tuple(row) == ("k", 2, "i")


def test_long_texts(spark):
    rng = random.Random(9)
    items = [(1, " ".join(f"q{rng.randrange(50)}" for _ in range(40)))]
    text = " ".join(f"q{rng.randrange(50)}" for _ in range(60_000)) + " " + items[0][1] + " " + " ".join(f"q{rng.randrange(50)}" for _ in range(20_000))
    (n, h, x), = brute([(5, text)], items)
    assert run(spark, [(5, text)], items) == [(False, 5, n, h, tuple(x))] and h >= 40


def test_a_template_in_all_items_and_texts_joins_nothing(spark, monkeypatch):
    rng = random.Random(3)
    template = "what is the right answer to this".split()                  # shorter than a window
    said = lambda: " ".join([f"w{rng.randrange(10**6)}" for _ in range(9)] + template + [f"w{rng.randrange(10**6)}" for _ in range(9)])
    for n in (60, 120):
        rows, keep = {}, module.common.stage

        def stage(df, name, rows=rows, keep=keep):
            out = keep(df, name)
            rows[name] = out.count()
            return out
        monkeypatch.setattr(module.common, "stage", stage)
        got = run(spark, [(i, said()) for i in range(n)], [(i, said()) for i in range(n)])
        monkeypatch.setattr(module.common, "stage", keep)
        assert all(not r[3] for r in got) and rows["extended"] <= 12 * n and rows["shared-windows"] == rows["spans"] == 0
