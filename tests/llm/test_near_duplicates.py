import glob
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from veilframe import session
from veilframe.llm import near_duplicates as N
from veilframe.llm.components import components


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), N.LAST), N.LAST if d is None else d)
    return sorted(((d, len(s), None if least[root(i)] == N.LAST else least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as doc", "1 as th", "2 as cid", "'y' as n")
    out = N.near_duplicates(df.repartition(3), **options).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 5, 20, 60, 150]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            docs.append(" ".join(w).upper() if rng.random() < 0.2 else "\n ".join(w))
    rng.shuffle(docs)
    return [(i * 7 % 100003, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", range(2))
def test_agrees_with_brute_force(spark, seed):
    docs = corpus(seed, 30, 14)
    docs += [(None, docs[0][1]), (None, "alone in the table"), (100004, None), (100005, ""), (100006, " \n"), (100007, "one"), (100008, "ONE"), docs[1], docs[1], (docs[2][0], "other text with an id seen before")]
    assert run(spark, docs) == brute(docs)


def test_large_nodes_branch_and_are_dealt_into_blocks(spark, monkeypatch):
    docs = corpus(5, 3, 60)
    expected = brute(docs)
    assert run(spark, docs, limit=8) == expected
    monkeypatch.setattr(N, "DEPTH", 3)
    assert run(spark, docs, limit=6) == expected


def test_no_rows_and_long_text(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    long = " ".join(str(i % 40000) for i in range(100_000))
    docs = [(1, long), (2, long + " end"), (3, "short")]
    assert run(spark, docs) == brute(docs)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_pairs_that_meet_in_a_node_that_branches(spark):
    import numpy as np
    import pyarrow as pa
    rng = np.random.Generator(np.random.Philox(4))
    own = np.repeat(rng.integers(0, 1 << 32, (1, N.TOKENS), np.uint32), 2, axis=0)
    own[1, rng.permutation(N.TOKENS)[:10]] ^= np.uint32(1)          # of similarity 0.84, by estimate
    nodes = N._start_nodes(own)
    shared = np.flatnonzero(nodes[0] == nodes[1])
    assert len(shared) > 1

    def kept(place, large):
        columns = {"node": pa.array([nodes[0, place].view(np.int64)] * 2, pa.int64()), "cid": pa.array([1, 2]), "doc": pa.array([1, 2]), "th": pa.array([3, 4]),
                   "start": pa.array([True, True]), "signature": pa.array([s.tobytes() for s in own], pa.binary()), "large": pa.array([large, large], pa.list_(pa.int64())), "label": pa.array([1, 2])}
        return sum(b.num_rows for b in N._with_partner(0.6)(iter([pa.RecordBatch.from_pydict(columns)])))
    before = nodes[0, shared[:-1]].view(np.int64).tolist()
    assert kept(shared[0], None) == 2 and kept(shared[-1], None) == 0
    assert kept(shared[-1], before) == 2 and (len(before) < 2 or kept(shared[-1], before[1:]) == 0)


def test_classes_know_their_large_start_nodes(spark):
    members = spark.createDataFrame([(1, c, 5) for c in range(9)] + [(2, 0, 5), (2, 1, 5)], "node long, cid long, n long")
    classes = spark.createDataFrame([(c, 5, bytes([c]) * 4 * N.TOKENS) for c in range(9)], "cid long, n long, signature binary")
    nodes, parted = N._in_nodes(members, classes, 4)
    assert {(r.node, r.cid) for r in nodes.where("start").collect()} == {(2, 0), (2, 1)}
    assert {r.cid: r.large for r in parted.collect()} == {c: [1] for c in range(9)}
    assert N._in_nodes(members, classes, 9)[1] is None


def test_the_estimate_seldom_drops_a_link():
    from math import ceil, comb
    for share in (0.8, 0.85):
        least = ceil((share - N.MARGIN * (share * (1 - share) / N.TOKENS) ** 0.5) * N.TOKENS - 1e-9)
        assert sum(comb(N.TOKENS, i) * share ** i * (1 - share) ** (N.TOKENS - i) for i in range(least)) < 1e-6


def near_copies(rng, words, copies, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(words)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("copies", (64, 128, 256))
def test_large_groups_of_near_copies_take_linear_work(spark, monkeypatch, copies):
    rng = random.Random(copies)
    texts = near_copies(rng, 300, copies, 7) + near_copies(rng, 300, 6, 4)
    texts += [" ".join(t.split()[:200] + [f"o{rng.randrange(10**9)}" for _ in range(30 + 10 * i)]) for i, t in enumerate(texts[:12])]       # alike, but less
    docs = [(i * 7 % 10007, t) for i, t in enumerate(texts)]
    staged = []
    keep = N.common.stage

    def stage(df, name):
        out = keep(df, name)
        staged.append((name, out))
        return out
    monkeypatch.setattr(N.common, "stage", stage)
    assert run(spark, docs, limit=32) == brute(docs)
    rows = lambda what: sum(df.count() for name, df in staged if name == what)
    assert rows("partners") <= 20 * len(docs) and rows("nodes") + rows("start-nodes") <= 60 * len(docs)


def test_nodes_are_bounded_by_their_shingles_too(spark, monkeypatch):
    docs = corpus(7, 6, 30)
    monkeypatch.setattr(N, "SHINGLES", 400)
    assert run(spark, docs) == brute(docs)


def test_one_of_each_keeps_columns_of_any_name_and_type(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", {"k": 1}, 5), (2, "a b c d e f", "y", {"k": 2}, 6), (2, "a b c d e f", "z", {"k": 2}, 6), (3, None, None, None, None), (4, "other", "q", {}, 0)],
                                 "doc_id long, text string, doc string, th map<string, int>, c1 int").selectExpr("*", "'p' as doc__", "'t' as th__", "'u' as place__", "'v' as place", "1 as component")
    out = N.one_of_each(docs, 80, 5)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.doc, r.c1, r.doc__, r.th__, r.place__) for r in out.where("doc_id <> 3").collect()) == [(1, "x", 5, "p", "t", "u"), (4, "q", 0, "p", "t", "u")]
    assert out.where("doc_id = 3").count() == 1


def test_signatures_hold_two_bytes_a_token_that_differ_between_texts(spark):
    from veilframe.llm import near_duplicates as N
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(200)]
    rows = spark.createDataFrame([(i, i, i, t) for i, t in enumerate(texts)], "doc_id bigint, doc bigint, th bigint, text string")
    own = [r.signature for r in N._measure(rows, 3).collect()]
    assert {len(s) for s in own} == {2 * N.TOKENS}
    first = {bytes(s[:2]) for s in own}
    assert len(first) > 190


def test_nodes_of_one_class_are_written_once_and_texts_without_a_partner_stay(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    docs += [(100 + i, t + " end") for i, (_, t) in enumerate(docs[:3])]
    staged, keep = [], N.common.stage

    def stage(df, name):
        out = keep(df, name)
        staged.append((name, out.count()))
        return out
    monkeypatch.setattr(N.common, "stage", stage)
    assert run(spark, docs) == brute(docs)
    rows = lambda what: [n for name, n in staged if name == what]
    assert rows("nodes") == [] and len(rows("start-nodes")) == 1
    assert len(rows("shared-nodes")) == 1 and 0 < rows("shared-nodes")[0] < rows("start-nodes")[0] / 4
    monkeypatch.setattr(N.common, "BROADCAST_BYTES", -1)            # all texts move
    assert run(spark, docs) == brute(docs) and run(spark, docs, limit=1) == brute(docs)


def test_tables_of_few_rows_go_to_few_files_however_many_partitions_there_are(spark):
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    docs = corpus(5, 14, 8)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        with session.staged_inside() as paths:
            assert run(spark, docs, limit=4) == brute(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p: len(glob.glob(f"{p}/part-*")) for p in paths}
    narrow = [n for p, n in files.items() if re.search("/(links|known|classes|shared-nodes|partner-texts)-", p)]
    assert len(narrow) > 5 and max(narrow) <= session.tasks_for(len(docs) * N.TREES * 2 ** N.START, spark.sparkContext.defaultParallelism) < 4


def test_a_full_node_is_linked_within_bounded_memory():
    rng, k = random.Random(8), 1500
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i % 60], f"n{rng.randrange(10 ** 6)}", *base[i % 60 + 1:]]) for i in range(k)]
    batch = pa.RecordBatch.from_pydict({"node": pa.array([1] * k), "cid": pa.array(range(k)), "text": pa.array(texts)})
    tracemalloc.start()
    try:
        found = [row for b in N._link(80, 3)(iter([batch])) for row in b.to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert sorted(r["a"] for r in found) == list(range(1, k)) and {r["b"] for r in found} == {0}
