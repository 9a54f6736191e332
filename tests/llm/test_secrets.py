import random
import re

from veilframe.llm.secrets import find_secrets, without_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, z) for a, _, k, z in sorted(out)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as uid", "1 as kind", "2 as start")


def test_patterns_agree_with_brute_force(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "secret=", "api_key", "APIKEY", " ", ":", "=", '"', "'", "é😀", "AKIA", "ABCDEFGHIJKLM", "0123456789abcdef",
             "short", "longer.value==", "\n", "x", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(30)))) for i in range(300)]
    rows += [(1, None), (None, ""), (5, "token=secret :abcdefghijk"), (6, "a" * 50000), (7, "password=abcdefgh1 " * 3000), (7, "password=abcdefgh1 " * 3000)]
    found = find_secrets(table(spark, rows)).collect()
    clean = sorted(str(r.doc_id) for r in without_secrets(table(spark, rows)).collect())
    assert clean == sorted(str(r.doc_id) for r in found if not r.found)
    got = sorted((str(r.doc_id), [tuple(x) for x in r.found if x.kind != "random"]) for r in found)
    assert got == sorted((str(i), brute(t)) for i, t in rows)


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(4)
    words = ["customer", "account", "service", "request", "handler", "manager", "index", "table", "value", "number", "update"]
    plain = [(i, " ".join("_".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(200))) for i in range(60)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [(100 + i, f"see {''.join(rng.choices(letters, k=36))} there") for i in range(40)]
    found = {r.doc_id: [tuple(x) for x in r.found] for r in find_secrets(table(spark, plain + keys)).collect()}
    assert sum(found[i] != [] for i, _ in plain) == 0
    assert sum(found[i] == [("random", 4, 40)] for i, _ in keys) >= 38


def test_no_rows(spark):
    assert find_secrets(table(spark, [])).count() == 0


def test_all_documents_are_learned_from(spark):
    from collections import Counter
    from math import log
    from veilframe.llm.secrets import CODES, FIRST, SMOOTHING, learn
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}word Zq{chr(65 + i % 26)}{chr(65 + i // 300)}" for i in range(6000)]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    found, nothing = learn(frame(texts)), learn(frame([]))
    pairs = Counter(w[i:i + 2] for t in texts for w in t.split() for i in range(len(w) - 1))
    rows = Counter()
    for ab, n in pairs.items():
        rows[ab[0]] += n
    for ab, n in pairs.items():
        place = (ord(ab[0]) - FIRST) * CODES + ord(ab[1]) - FIRST
        ordinary = log((n + SMOOTHING) / (rows[ab[0]] + SMOOTHING * CODES))
        assert abs(found[place] - (nothing[place] - log(CODES) - ordinary)) < 1e-3
