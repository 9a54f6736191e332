import pytest
from pyspark.sql import functions as F

import veilframe as vf
from tests.people import COLUMNS, ROWS
from veilframe.operators import detect
from veilframe.plans.config import build_config, column_entities, override_config

KEY = "row_id"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join([f"{KEY} bigint", *[f"{c} string" for c in COLUMNS]])).repartition(3).cache()


@pytest.fixture(scope="module")
def found(people):
    return vf.detect(people, KEY).cache()


def test_confidences(found):
    rows = {(r.column, r.entity): r for r in found.collect()}
    wanted = {
        ("customer_id", "CUSTOMER_ID"): 0.90, ("customer_name_ar", "ARABIC_PERSON_NAME"): 0.90,
        ("customer_name_en", "PERSON_NAME"): 0.90, ("national_id", "SAUDI_NATIONAL_ID"): 0.97,
        ("mobile", "SAUDI_MOBILE"): 0.97, ("email", "EMAIL_ADDRESS"): 0.99, ("iban", "SAUDI_IBAN"): 0.99,
        ("address_ar", "SAUDI_ADDRESS"): 0.90, ("age", "AGE"): 0.95, ("gender", "GENDER"): 0.95, ("city", "CITY"): 0.95,
        ("district", "DISTRICT"): 0.70, ("job", "JOB_TITLE"): 0.70, ("salary", "SALARY"): 0.95,
        ("order_ref", "SAUDI_NATIONAL_ID"): 0.47, ("notes", "EMAIL_ADDRESS"): 0.99,
        ("notes", "SAUDI_NATIONAL_ID"): 0.95, ("notes", "SAUDI_MOBILE"): 0.95}
    assert {k: r.confidence for k, r in rows.items() if k in wanted} == wanted
    others = {k: r.confidence for k, r in rows.items() if k not in wanted}
    assert all(c < 0.5 for c in others.values()), others
    assert not rows["order_ref", "SAUDI_NATIONAL_ID"].flagged
    assert [rows["notes", e].embedded for e in ("EMAIL_ADDRESS", "SAUDI_NATIONAL_ID", "SAUDI_MOBILE")] == [True] * 3
    assert rows["age", "AGE"].risk == "MEDIUM" and rows["city", "CITY"].risk == "LOW"


def test_views(people, found):
    summary = vf.dataset_summary(people, found, len(COLUMNS)).first().asDict()
    assert summary == {"records": 48, "columns": 18, "sensitive_fields": 15, "direct": 9, "indirect": 6, "high_risk": 8}
    assert {r.column for r in vf.candidates(found).collect()} == {"order_ref"}
    assert vf.by_category(found, "Indirect").count() == 6
    assert sum(r.findings for r in vf.by_entity_risk(found).collect()) == vf.flagged(found).count()


def test_reasons_and_samples(people):
    rows = {(r.column, r.entity): r for r in vf.explain(people, KEY).collect()}
    national = rows["national_id", "SAUDI_NATIONAL_ID"]
    assert national.reasons == [
        "Matches Saudi National ID / Iqama pattern in the whole cell in 48/48 values (100%)",
        "Passes the Saudi National ID / Iqama checksum in 48/48 values (100%)", "Column name contains 'national id'"]
    assert national.samples == [r[3] for r in ROWS[:3]]
    reference = rows["order_ref", "SAUDI_NATIONAL_ID"]
    assert "Pattern matches but the checksum FAILS (Saudi National ID / Iqama) → probably not a real identifier" in reference.reasons
    assert reference.reasons[-1] == "No supporting context (column name / nearby words) → confidence stays limited"
    note = rows["notes", "SAUDI_MOBILE"]
    assert note.reasons == ["Matches Saudi mobile number pattern inside free text in 5/48 values (10%)",
                            "Context phrase 'mobile' found next to the value in 5/5 values (100%)"]
    assert note.samples == [r[17] for r in ROWS[12:15]]
    assert rows["gender", "GENDER"].reasons == [
        "Column name contains 'gender'", "Only 2 distinct values (typical for gender)",
        "Indirect identifier: risky when COMBINED with other fields (suggested – please confirm)"]
    assert rows["customer_id", "CUSTOMER_ID"].reasons[1] == "100% of values are unique (behaves like an identifier)"
    assert rows["address_ar", "SAUDI_ADDRESS"].reasons[0] == "Address keywords (حي, شارع) found in 48/48 values (100%)"
    assert rows["customer_name_ar", "ARABIC_PERSON_NAME"].samples == [r[1] for r in ROWS[:3]]


def test_first_samples_do_not_depend_on_lanes(spark):
    # the first three hits sit in rows whose keys fall anywhere, among many non-hits
    rows = [(i, f"u{i}@mail.org" if i % 97 == 5 else "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, contact string").repartition(7)
    row = vf.explain(df, KEY).where("entity = 'EMAIL_ADDRESS'").first()
    assert row.samples == ["u5@mail.org", "u102@mail.org", "u199@mail.org"]


def test_hint_without_match_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "abc", None, " "), (2, "def", None, ""), (3, None, None, None)],
                               "row_id bigint, mobile string, email string, age string")
    rows = vf.detect(df, KEY).collect()
    assert [(r.column, r.entity, r.confidence, r.flagged) for r in rows] == [("mobile", "SAUDI_MOBILE", 0.3, False)]
    assert rows[0].reasons == ["Column name contains 'mobile' but no value matches the Saudi mobile number pattern"]
    assert vf.detect(df.limit(0), KEY).count() == 0


def test_approximate(people):
    exact = {(r.column, r.entity): r.confidence for r in vf.detect(people, KEY).collect()}
    rough = {(r.column, r.entity): r.confidence for r in vf.detect(people, KEY, approximate=True).collect()}
    assert exact.keys() == rough.keys() and all(abs(exact[k] - rough[k]) <= 0.03 for k in exact)


def test_plan_reads_the_table_once_and_shuffles_counters(spark):
    plain = spark.range(9).select(F.col("id").alias(KEY), *[F.col("id").cast("string").alias(c) for c in COLUMNS])
    lanes = detect._lane_totals(detect._cell_flags(detect.cells(plain, KEY, COLUMNS), detect.hints_for(COLUMNS)))
    plan = lanes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("profile, methods", [
    ("external", {"national_id": "Suppression", "mobile": "Masking", "notes": "Masking", "age": "Generalization",
                  "customer_id": "Hashing", "customer_name_ar": "Replacement", "district": "Suppression",
                  "gender": "Keep", "order_ref": "Keep", "city": "Generalization"}),
    ("developer", {"national_id": "Replacement", "email": "Replacement", "city": "Keep", "notes": "Masking",
                   "address_ar": "Generalization"}),
    ("internal", {"national_id": "Masking", "iban": "Masking", "job": "Keep", "district": "Generalization"})])
def test_config(found, profile, methods):
    config = build_config(found, COLUMNS, profile)
    rows = {r.column: r for r in config.collect()}
    assert [r.column for r in config.orderBy("position").collect()] == COLUMNS
    assert {c: rows[c].method for c in methods} == methods
    assert rows["notes"].detected.startswith("EMAIL_ADDRESS, ") and rows["order_ref"].detected == "—"
    changed = override_config(config, {"email": "Keep"}, {"monthly_spending": "Indirect"})
    assert {r.column: r.method for r in changed.collect()}["email"] == "Keep"
    with pytest.raises(ValueError):
        override_config(config, {"email": "Shred"})


def test_entity_order(spark):
    rows = [("c", "EMAIL_ADDRESS", "Direct", 0.6, 3, False, True), ("c", "CUSTOMER_ID", "Direct", 0.9, 6, False, True),
            ("c", "AGE", "Indirect", 0.99, 7, False, True), ("c", "CITY", "Indirect", 0.2, 8, False, False)]
    found = spark.createDataFrame(rows, "column string, entity string, category string, confidence double, place int, "
                                        "embedded boolean, flagged boolean")
    assert column_entities(found).first().entities == ["CUSTOMER_ID", "EMAIL_ADDRESS", "AGE"]
    # the plan puts the higher base risk first, the treatment the surer entity
    assert build_config(found, ["c"], "external").first().detected == "EMAIL_ADDRESS, CUSTOMER_ID, AGE"


def test_plans_read_what_they_need(spark, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "t")
    spark.range(4000).select(F.col("id").alias(KEY), F.lit("x").alias("gender"), F.lit("plain words").alias("note"),
                             F.when(F.col("id") == 10, "a@b.com").otherwise("n").alias("contact")).write.parquet(path)
    df = spark.read.parquet(path)

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()
    gender = plan(detect.profile_columns(df, KEY, entities={"GENDER"}))
    assert "note" not in gender and "contact" not in gender and "SortAggregate" not in gender
    counted = detect.profile_columns(df, KEY)
    assert "SortAggregate" not in plan(counted)
    schemas = [line for line in plan(counted).split("\n") if "ReadSchema" in line]
    assert len(schemas) == 2 and sum("note" in s for s in schemas) == 1
    rows = counted.collect()
    values = detect.first_values(df, KEY, ["gender", "note", "contact"], rows)
    assert "PushedFilters: [IsNotNull" in plan(values) and "LessThanOrEqual" in plan(values)      # one stray match bounds itself
    assert {r["column"]: r["values"] for r in values.where("sample_group = 'email'").collect()} == {"contact": ["a@b.com"]}


def test_an_entity_of_ones_own(spark):
    from pyspark.sql import functions as F
    df = spark.range(60).select(F.col("id").alias(KEY), F.format_string("PX-%05d-Q", "id").alias("badge"), F.lit("nothing").alias("other"))
    assert vf.detect(df, KEY).where("flagged").count() == 0
    vf.register_entity("STAFF_BADGE", r"PX-[0-9]{5}-[A-Z]", "Staff badge", weight=0.8, column_keywords=("badge",), context_keywords=("badge",),
                       mask=lambda c, strength: F.regexp_replace(c, "[0-9]", "#"))
    try:
        found = vf.detect(df, KEY)
        assert [(r.column, r.entity, r.label) for r in found.where("flagged").collect()] == [("badge", "STAFF_BADGE", "Staff badge")]
        config = build_config(found, ["badge", "other"], "internal")
        from veilframe.plans.anonymize import anonymize
        data = anonymize(df, config, found, "internal", KEY, staged=False).data
        assert data.orderBy(KEY).first().badge == "PX-#####-Q"
        texts = spark.createDataFrame([(1, "my badge PX-12345-Z is here")], "id int, text string")
        assert [(r.start, r.end, r.entity) for r in vf.corpus_findings(texts, "id", "text").collect()] == [(9, 19, "STAFF_BADGE")]
        assert vf.mask_text(texts, "text").first().text == "my badge PX-#####-Z is here"
        with pytest.raises(ValueError):
            vf.register_entity("STAFF_BADGE", "x", "twice")
    finally:
        vf.forget_entity("STAFF_BADGE")
    assert vf.detect(df, KEY).where("flagged").count() == 0


def test_short_text_keys_are_held_as_numbers(spark):
    import random
    from veilframe.operators import detect as D
    rng = random.Random(4)
    keys = ["", "a", "B", "é", "漢字", "zz", "a b", "user-000000001", "\U0001F600" * 3, "123456789012345", *["".join(rng.choices("ab01", k=rng.randrange(16))) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("n", D._number_of(F.col("k")))
    assert [r.k for r in df.orderBy("n", "k").collect()] == [r.k for r in df.orderBy("k").collect()]
    assert all(r.k == r.t for r in df.select("k", D._text_of(F.col("n")).alias("t")).collect())
    assert df.select(F.count_distinct("n")).first()[0] == len(set(keys))
    assert D._fits_a_number(df, "k") and not D._fits_a_number(spark.createDataFrame([("x" * 16,)], "k string"), "k")
    assert not D._fits_a_number(spark.createDataFrame([("a\x00",)], "k string"), "k") and D._fits_a_number(spark.createDataFrame([(None,)], "k string"), "k")


def test_text_keys_give_the_same_findings_without_a_sort(people, found):
    from veilframe.operators import detect as D
    texts = people.withColumn(KEY, F.format_string("key-%06d", F.col(KEY)))
    longer = people.withColumn(KEY, F.format_string("a-much-longer-key-%06d", F.col(KEY)))
    plan = D.profile_columns(texts, KEY, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    order = lambda df: sorted(map(str, df.collect()))
    assert order(D.detect(texts, KEY, COLUMNS)) == order(D.detect(people, KEY, COLUMNS)) == order(D.detect(longer, KEY, COLUMNS))
    assert order(D.explain(texts, KEY, COLUMNS)) == order(D.explain(people, KEY, COLUMNS))
