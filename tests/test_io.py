import pytest
import veilframe as vf
from tests.people import COLUMNS, ROWS
from veilframe.operators.utility import assess_utility
from veilframe.plans.anonymize import Treatment, anonymize
from veilframe.plans.config import build_config
from veilframe.session import stage, work_folder
from veilframe.sources import readers, writers
from veilframe.streaming import mask_stream


def test_csv_is_text_and_tolerates_a_bom(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,mobile,note\n007,0551234567,"a, ""b"""\n8,n/a,\n', encoding="utf-8")
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["id", "mobile", "note"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [("007", "0551234567", 'a, "b"'), ("8", None, None)]
    assert readers.read_csv(spark, str(path), missing_words=False).collect()[1].mobile == "n/a"


def test_each_file_in_its_encoding(spark, tmp_path):
    (tmp_path / "utf8.csv").write_text("name,الاسم\nx,هند\n", encoding="utf-8-sig")
    (tmp_path / "arabic.csv").write_bytes("name,الاسم\ny,فاطمة€\n".encode("cp1256"))
    audit = {r.path.split("/")[-1]: r.encoding for r in readers.audit_encodings(spark, str(tmp_path)).collect()}
    assert audit == {"utf8.csv": "UTF-8", "arabic.csv": "windows-1256"}
    rows = readers.read_csv_folder(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [("x", "هند"), ("y", "فاطمة€")]


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "a,b", "حي"), ("2", None, ' "q" '), ("3", "  ", "x")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    writers.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_saved_run(spark, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], ", ".join(["row_id bigint", *[f"{c} string" for c in COLUMNS]]))
    found = stage(vf.detect(df, "row_id"), "found")
    config = build_config(found, COLUMNS, "external")
    result = anonymize(df, config, found, "external", "row_id", salt="s")
    writers.save_run(str(tmp_path / "run"), found, config, result, vf.assess_risk(result), assess_utility(result))
    loaded = writers.load_run(spark, str(tmp_path / "run"))
    assert loaded["config"].count() == 18 and loaded["data"].count() == 48 and loaded["risk"].first().level_before == "HIGH"
    key, treatments = writers.load_treatments(spark, str(tmp_path / "run"))
    assert key == "external" and treatments == result.treatments
    assert loaded["detections"].count() == found.count() and loaded["utility"].first().score > 50


def test_tables_are_read_as_they_lie(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert "Exchange" not in readers.read_parquet(spark, str(tmp_path / "one"))._jdf.queryExecution().toString()


def test_csv_keeps_line_ends_and_refuses_what_it_would_break(spark, tmp_path):
    rows = [("1", "two\nlines", "x"), ("2", "a\r\nb\n", "y")]
    writers.write_csv(spark.createDataFrame(rows, "k string, a string, b string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == rows
    for name, text in (("long", "k,a\n1,2,3\n"), ("short", "k,a\n1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception):
            readers.read_csv(spark, str(tmp_path / f"{name}.csv")).collect()


def test_headers_of_any_order_are_brought_together(spark, tmp_path):
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_text("id,name\n1,Sara\n")
    (tmp_path / "mixed" / "b.csv").write_text("\ufeffname,id\r\nHind,2\r\n", encoding="utf-8")
    (tmp_path / "mixed" / "c.csv").write_text('name,id,note\n"Lina",3,"two\nlines"\n')
    (tmp_path / "mixed" / "d.csv").write_bytes("name,id\nهند,4\n".encode("cp1256"))
    (tmp_path / "mixed" / "e.csv").write_text("")
    for rows in (readers.read_csv_folder(spark, str(tmp_path / "mixed")).collect(),):
        assert sorted((r["id"], r["name"], r["note"]) for r in rows) == [("1", "Sara", None), ("2", "Hind", None), ("3", "Lina", "two\nlines"), ("4", "هند", None)]
    audit = {r.path.rsplit("/", 1)[1]: (r.is_utf8, r.quoted, r.header) for r in readers.audit_files(spark, str(tmp_path / "mixed")).collect()}
    assert audit["b.csv"][2] == audit["d.csv"][2] != audit["a.csv"][2] and [audit[f"{x}.csv"][:2] for x in "abcd"] == [(True, False), (True, False), (True, True), (False, False)]


def test_a_thousand_files_of_two_orders(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.csv").write_text(f"id,name\n{i},n{i}\n" if i % 3 else f"name,id\nn{i},{i}\n")
    rows = readers.read_csv_folder(spark, str(tmp_path)).collect()
    assert sorted(int(r.id) for r in rows) == list(range(1000)) and all(r.name == f"n{r.id}" for r in rows)


def test_a_large_plain_file_is_split(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("k,v\n" + "".join(f'{i},"said ""{i}"" to me"\n' for i in range(40_000)))
    (tmp_path / "quoted.csv").write_text("k,v\n" + "".join(f'{i},"said\n{i}"\n' for i in range(40_000)))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(64 << 10))
        plain, quoted = (readers.read_csv(spark, str(tmp_path / f"{n}.csv")) for n in ("plain", "quoted"))
        assert plain.rdd.getNumPartitions() >= 8 and quoted.rdd.getNumPartitions() == 1
        assert plain.count() == quoted.count() == 40_000 and plain.where("v = concat('said \"', k, '\" to me')").count() == 40_000
    finally:
        spark.conf.set(setting, before)


def test_scratch_leaves_nothing(spark, tmp_path):
    import os
    held = lambda: {n for n in os.listdir(work_folder(spark)) if n.startswith(("mine", "treated", "numbers", "distinct"))}
    before = held()
    with pytest.raises(ValueError):
        with vf.scratch(spark):
            stage(spark.range(3), "mine")
            raise ValueError
    assert held() == before
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], ", ".join(["row_id bigint", *[f"{c} string" for c in COLUMNS]]))
    with vf.scratch(spark):
        found = stage(vf.detect(df, "row_id"), "mine")
        result = anonymize(df, build_config(found, COLUMNS, "external"), found, "external", "row_id")
        assert not [n for n in held() - before if n.startswith(("numbers", "distinct"))]
        result.data.write.parquet(str(tmp_path / "kept"))
    assert held() == before and spark.read.parquet(str(tmp_path / "kept")).count() == 48


def test_staged_tables_go_to_the_configured_folder(spark):
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5 and staged.inputFiles()[0].startswith("file://" + work_folder(spark))


def test_stream_equals_batch(spark, tmp_path):
    texts = [(str(i), f"call 05{i:08d} or u{i}@mail.org {'٣' * (i % 3)}") for i in range(60)]
    df = spark.createDataFrame(texts, "id string, text string").repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for name, f in (("mask", lambda d: mask_stream.masked_stream(d, "text")), ("find", lambda d: mask_stream.findings_stream(d, "id", "text"))):
        out = str(tmp_path / name)
        mask_stream.write_available(f(arriving), out, str(tmp_path / f"{name}-state")).start().awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, f(df).collect()))


def test_treatments_decided_on_a_batch_run_on_a_stream(spark, tmp_path):
    rows = [(i, r[3], r[8], r[1]) for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows, "row_id bigint, national_id string, age string, name string").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("row_id bigint, national_id string, age string, name string").parquet(str(tmp_path / "in"))
    treatments = [Treatment("national_id", "Hashing", "Direct", ["SAUDI_NATIONAL_ID"]),
                  Treatment("age", "Generalization", "Indirect", ["AGE"], kind="numeric", rule="numeric", width=10.0),
                  Treatment("name", "Replacement", "Direct", ["ARABIC_PERSON_NAME"])]
    treated = mask_stream.treated_stream(arriving, treatments, "developer", "s", "row_id")
    mask_stream.write_available(treated, str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 48
    assert out.where("national_id rlike '^H_[0-9a-f]{32}$' and age rlike '^[0-9]0–[0-9]0$'").count() == 48
    with pytest.raises(ValueError):
        mask_stream.treated_stream(arriving, treatments, "external", "s", "row_id")


def test_entities_of_ones_own_travel_with_a_run(spark, tmp_path):
    from pyspark.sql import functions as F
    from veilframe.plans.entities import entities_table
    valid = lambda c: F.lit(True)
    try:
        vf.register_entity("STAFF_BADGE", r"PX-[0-9]{5}-[A-Z]", "Staff badge", column_keywords=("badge",), recommended=("Hashing", "Replacement", "Masking"))
        vf.register_entity("LOCKER", r"LK[0-9]{3}", "Locker", validator=valid)
        entities_table(spark).write.parquet(str(tmp_path / "entities"))
        assert vf.load_entities(spark, str(tmp_path)) == []
    finally:
        vf.forget_entity("STAFF_BADGE")
        vf.forget_entity("LOCKER")
    assert entities_table(spark).count() == 0
    df = spark.createDataFrame([(i, f"PX-{i:05d}-Q") for i in range(20)], "row_id long, badge string")
    assert vf.detect(df, "row_id").where("entity = 'STAFF_BADGE'").count() == 0
    try:
        with pytest.raises(ValueError, match="validator"):
            vf.load_entities(spark, str(tmp_path))
        loaded = vf.load_entities(spark, str(tmp_path), {"LOCKER": valid})
        found = vf.detect(df, "row_id").where("entity = 'STAFF_BADGE' and flagged")
        assert set(loaded) <= {"STAFF_BADGE", "LOCKER"} and found.count() == 1
        assert vf.build_config(found, ["badge"], "external").first().method == "Hashing"
    finally:
        vf.forget_entity("STAFF_BADGE")
        vf.forget_entity("LOCKER")
