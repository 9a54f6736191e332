import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm.quality import judge, without_lines


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as uid", "1 as host", "2 as h", "3 as w")


@pytest.mark.parametrize("seed", range(2))
def test_counts_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", "😀#", "$%", "x&y"][:3 + 3 * seed]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", "\x0b", " ", "\r\n"]) for _ in range(rng.randrange(120))), "s") for i in range(80)]
    rows += [(1, None, None), (None, "", "s"), (2, " \n ", "s"), (3, "w " * 30000, "s"), (4, " ".join(map(str, range(20000))), None), (4, "a b", "s")]
    got = judge(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, ((r[0], *r[1:]) for r in got))) == sorted(str((i, *brute(t))) for i, t, _ in rows)


def test_boilerplate_depletes(spark):
    rng = random.Random(1)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    shared = "Subscribe now to our Newsletter number 77 " + "and read more of what we wrote about this and other things that you may like or not like at all"
    rows = [(i, f"{own(40)}\n{shared}\n{own(40)}", "s") for i in range(30)]
    rows += [(100 + i, f"{own(8)}\n{shared.upper().replace('77', '5')}", "s") for i in range(5)]
    rows += [(200, f"{own(8)}\n{shared}", "other")]
    copy = "\n".join(own(30) for _ in range(5))
    rows += [(300 + i, copy, "s") for i in range(40)]
    out = {r.doc_id: r for r in judge(table(spark, rows)).collect()}
    assert all(out[i].kept and out[i].n_left < out[i].n_words for i in range(30))
    assert not any(out[100 + i].kept for i in range(5)) and out[200].kept
    assert all(out[300 + i].kept for i in range(40))                # copies of a document are one document
    docs = table(spark, rows[:1])
    cleaned = docs.select(without_lines(F.col("text"), F.array(*[F.lit(h) for h in out[0].boilerplate]))).first()[0]
    assert cleaned.count("\n") == 1 and "Subscribe" not in cleaned


def test_no_rows(spark):
    assert judge(table(spark, [])).count() == 0


def test_lines_count_by_document(spark):
    rng = random.Random(3)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    footer = [f"footer line {c} of the site" for c in "abcde"]
    rows = [(i, "\n".join([own(30), *footer]), "s") for i in range(20)]
    rows += [(50 + i, "\n".join([own(2), *footer]), "s") for i in range(3)]                               # mostly footer
    rows += [(100, "\n".join(f"{own(1)}\nthe refrain of one song only" for _ in range(15)), "t"), (101, own(30), "t")]
    rows += [(200 + i, f"{own(30)}\nin copies and elsewhere", "u") for i in range(2)] + [(210 + i, f"{'w ' * 20}\nin copies and elsewhere", "u") for i in range(30)]
    out = {r.doc_id: r for r in judge(table(spark, rows), min_share=0.5).collect()}
    assert all(len(out[i].boilerplate) == 5 and out[i].n_left == 30 and out[i].kept for i in range(20))
    assert all(len(out[50 + i].boilerplate) == 5 and out[50 + i].n_left == 2 and not out[50 + i].kept for i in range(3))
    assert not any(out[i].boilerplate for i in (100, 101, 200, 201, 210))


def test_copies_count_once_in_the_size_of_a_host(spark):
    rows = [(i, f"own {chr(97 + i)}\nthe line that they share", "s") for i in range(12)] + [(100 + i, "a copy", "s") for i in range(60)]
    out = {r.doc_id: r for r in judge(table(spark, rows), min_share=0.5).collect()}
    assert all(len(out[i].boilerplate) == 1 for i in range(12)) and not out[100].boilerplate


def normal(line):
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line)).strip(" ")


def brute_lines(rows, min_documents, min_share, least_left):
    """(words left, kept) of each row, by counting the distinct texts of a host that hold a line."""
    hosts, on = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                on.setdefault((host, normal(line)), set()).add(text)
    out = []
    for _, text, host in rows:
        n, *_, failed = brute(text)
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in (text or "").split("\n")
                   if len(on.get((host, normal(line)), ())) > max(min_documents, min_share * len(hosts[host])))
        out.append((n - lost, not failed and n - lost >= least_left * n))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_frequency_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["one", "two", "THREE", "4", "55", "six"], k=9)) for _ in range(30)]
    own = lambda: " ".join(f"w{rng.randrange(10**6)}x" for _ in range(rng.randrange(12)))
    rows = []
    for i in range(150):
        lines = [rng.choice([own(), pool[int(rng.paretovariate(0.7)) % 30], pool[0].lower().replace("55", "7"), "  "]) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", ""])))
    rows += [(200 + i, *rows[i][1:]) for i in range(40)] + [(300, None, "a"), (301, "", None), (302, pool[1] + "\n" + pool[1], None)]
    out = judge(table(spark, rows), 3, 0.05, 0.3).select("doc_id", "n_left", "kept").collect()
    wanted = brute_lines([(i, t, h or "") for i, t, h in rows], 3, 0.05, 0.3)
    assert sorted(tuple(r) for r in out) == sorted((i, *x) for (i, _, _), x in zip(rows, wanted))
    assert any(left < brute(t)[0] for (left, _), (_, t, _) in zip(wanted, rows))
