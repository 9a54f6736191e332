import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline

EN = "the of and to in is that with for was on are by from this have not they which one you were her all she there would their".split()
FR = "le la les des une est dans pour que avec sur pas plus par qui sont mais nous vous cette leur ont tout fait être aux ses".split()


def brute(docs, items):
    """Ids that each stage keeps, by definition, for texts whose language is plain from their letters."""
    from tests.llm.test_secrets import brute as secrets
    from tests.llm.test_decontaminate import brute as hits
    kept = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    grams = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} or {tuple(t.split())}
    groups = []
    for d in sorted(kept):
        near = [g for g in groups if any(100 * len(grams(d[1]) & grams(o[1])) >= 80 * len(grams(d[1]) | grams(o[1])) for o in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [d]]
    kept = sorted(min(g) for g in groups)
    kept = [d for d, (_, n, _) in zip(kept, hits([d[:2] for d in kept], items)) if not n]
    return [d for d in kept if not secrets(d[1])]


def test_stages_agree_with_brute_force(spark, tmp_path):
    rng = random.Random(6)
    say = lambda g, n: " ".join(rng.choice(g) for _ in range(n))
    docs = [(i, say(EN if i % 2 else FR, rng.randrange(30, 90)), "en" if i % 2 else "fr", "s", 1) for i in range(120)]
    items = [(i, say(EN, 14)) for i in range(5)] + [(9, None)]
    docs += [(200 + i, docs[i][1], "en", "s", None) for i in range(10)]
    docs += [(220 + i, docs[i + 20][1] + " end", None, None, 1) for i in range(10)]
    docs += [(240 + i, say(EN, 20) + " " + items[i][1] + " " + say(EN, 20), "en", "s", 1) for i in range(5)]
    docs += [(260 + i, say(FR, 30) + f" token = {rng.getrandbits(160):040x} " + say(FR, 9), "fr", "s", 1) for i in range(5)]
    docs += [(300, None, "en", "s", 1), (301, "", None, "s", 1), (302, "12 34 !", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = {d[0]: d for d in brute(docs, items)}
    assert rows.keys() == expected.keys() and len(rows) > 100
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in rows.items():
        assert (r.text, r.lang, r.source, r.n_chars) == expected[i][1:] and r.intact and r.n_tokens == len(r.ids) // 4
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text)


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, text_ string, ids string, hash string, th long"
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes and stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    rows = [(i, f"the words of text {chr(97 + i)} are here and there", "en", "s", 1, "s", 2, "t", "i", "h", 3) for i in range(3)]
    docs = spark.createDataFrame(rows, kinds)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    out = docs.collect()
    assert [r[:8] + r[8:10] for r in sorted(tuple(r)[:10] for r in out)] == [r[:8] + r[9:] for r in rows] and all(r.intact for r in out)


def test_one_of_rows_that_repeat(spark):
    from veilframe.llm.near_duplicates import one_of_each
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "", "x"), (2, "", "x"), (3, None, None)]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, doc string"), 80, 5).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, "a b c d e f", "x"), (2, "", "x"), (2, "", "x"), (3, None, None)]))
