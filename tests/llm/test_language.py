import random
import tracemalloc
import zlib

from pyspark.sql import functions as F

from veilframe.llm.language import held_out, identify, profiles

WORDS = {"en": "the of and to in is that with for was on are by".split(), "fr": "le la les des une est dans pour que avec sur pas".split(),
         "de": "der die das und ist nicht ein mit von zu auf für".split()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS[g], k=rng.randrange(5, 60))), g, "x", "y") for i, g in enumerate(rng.choices(list(WORDS), k=300))]
    docs = table(spark, rows)
    out = identify(docs, docs.where(~held_out("doc_id", 5, 0))).withColumn("out", held_out("doc_id", 5, 0)).collect()
    lang = {r[0]: r[2] for r in rows}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    tested = [r for r in out if r.out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.98 * len(tested) > 0
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    docs = table(spark, [(1, "the of and", "en", "", ""), (2, "le la les", "fr", "", ""), (3, None, "en", "", ""), (4, "", None, "", ""),
                         (5, "123 !?", "en", "", ""), (None, "the " * 40000, "en", "", ""), (1, "the of and", "en", "", ""), (6, "日本", None, "", "")])
    out = identify(docs, docs).select("doc_id", "lang_pred").collect()
    assert sorted((str(r[0]), r[1]) for r in out if r[0] != 6) == [("1", "en"), ("1", "en"), ("2", "fr"), ("3", "und"), ("4", "und"), ("5", "und"), ("None", "en")]
    assert [tuple(r) for r in identify(docs, docs.where("false")).select("lang_pred").distinct().collect()] == [("und",)]
    assert identify(docs.where("false"), docs).count() == 0


def test_bundles_are_sums_of_bound_grams():
    a, b, both = profiles(["abc", "xyz", "abc\n\nxyz"])
    assert abs(both @ a - both @ b) < 0.2 and both @ a > 0.5 and abs(a @ b) < 0.6 and not profiles(["12"])[0].any()


def test_labels_are_not_inputs(spark):
    docs = table(spark, [(i, t, g, "", "") for i, (t, g) in enumerate([("the of and", "en"), ("le la les", "fr")] * 20)])
    other = docs.withColumn("lang", F.lit("xx"))
    assert identify(docs, docs).select("lang_pred").collect() == identify(other, docs).select("lang_pred").collect()


def test_labels_of_one_language_and_texts_of_none(spark):
    import corpus_pipeline
    rng = random.Random(5)
    say = lambda g: " ".join(rng.choices(WORDS[g], k=rng.randrange(20, 60)))
    rows = [(i, say("en"), ("en", "en-US", "eng", "en-GB")[i % 4], "x", "y") for i in range(400)] + [(1000 + i, say("fr"), "fr", "x", "y") for i in range(100)]
    rows += [(2000 + i, "".join(rng.choices("bcdfghjklmnpqrstvwxz ", k=200)), None, "x", "y") for i in range(5)]
    got = {r.doc_id for r in corpus_pipeline.language(spark, table(spark, rows), "").collect()}
    assert got == {r[0] for r in rows if r[2]}


def test_every_language_is_learned(spark):
    from veilframe.llm.language import learn
    rows = [(i, "the of and", f"l{i:03}", "", "") for i in range(510)]
    assert learn(table(spark, rows))[0] == [r[2] for r in rows]


def test_all_texts_are_learned_from(spark):
    import numpy as np
    from veilframe.llm.language import UNIT, learn, profiles
    texts = [f"the of and {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    names, prototypes, least = learn(table(spark, [(i, t, "en", "", "") for i, t in enumerate(texts)]), True)
    sums = np.rint(profiles(texts).astype(np.float64) * UNIT).sum(axis=0)
    assert names == ["en"] and np.array_equal(prototypes[0], (sums / np.linalg.norm(sums)).astype(np.float32))
    assert np.isfinite(least).all()


def test_a_piece_of_many_grams_is_held_in_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000)) for _ in range(200)]
    profiles(texts[:1])               # the letters' vectors are made once
    tracemalloc.start()
    try:
        profiles(texts)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
