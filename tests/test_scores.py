import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import veilframe as vf
from tests.people import COLUMNS, ROWS
from veilframe.operators import risk, scoring
from veilframe.operators.utility import numeric_distribution
from veilframe.plans.anonymize import Treatment, anonymize
from veilframe.plans.config import build_config, override_config
from veilframe.session import stage

KEY = "row_id"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join([f"{KEY} bigint", *[f"{c} string" for c in COLUMNS]])).repartition(3).cache()


@pytest.fixture(scope="module")
def found(people):
    return vf.detect(people, KEY).cache()


@pytest.fixture(scope="module")
def results(people, found):
    return {p: anonymize(people, build_config(found, COLUMNS, p), found, p, KEY, salt="s") for p in vf.PROFILES}


def random_table(spark, q, n=400, seed=2):
    rng = random.Random(seed)
    rows = [tuple("hot" if rng.random() < 0.35 else rng.choice(["a", "b", "c", None]) for _ in range(q)) for _ in range(n)]
    names = [f"c{i}" for i in range(q)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).repartition(4), pd.DataFrame(rows, columns=names)


@pytest.mark.parametrize("q", [1, 2, 3, 5, 7])
def test_quasi_risk_equals_mean_of_one_over_k(spark, q):
    df, table = random_table(spark, q)
    table = table.fillna("∅")
    columns = list(table.columns)
    wanted = []
    for subset in itertools.combinations(columns, min(3, q)):
        sizes = table.groupby(list(subset))[subset[0]].transform("size")
        wanted.append((1 / sizes).mean())
    everyone = table.groupby(columns)[columns[0]].transform("size")
    got = risk.quasi_risk(df, columns)
    assert got.average == pytest.approx(sum(wanted) / len(wanted))
    assert (got.k, got.unique) == (everyone.min(), pytest.approx((everyone == 1).mean()))
    assert risk.quasi_risk(df, columns, approximate=True).average == pytest.approx(got.average, rel=0.05)


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_class_size_per_row(spark, broadcast_bytes):
    df, table = random_table(spark, 3)
    df = df.withColumn(KEY, F.monotonically_increasing_id())
    from veilframe.session import stage
    df = stage(df, "t")
    out = risk.class_size_per_row(df, KEY, ["c0", "c1", "c2"], broadcast_bytes=broadcast_bytes).toPandas().fillna("∅")
    assert len(out) == 400
    assert (out.groupby(["c0", "c1", "c2"])["c0"].transform("size") == out["class_size"]).all()


def test_no_quasi_columns(spark):
    df, _ = random_table(spark, 2)
    assert risk.quasi_risk(df, []) == risk.QuasiRisk(0.0, None, None)
    assert risk.quasi_risk(df.limit(0), ["c0"]).average == 0.0


@pytest.mark.parametrize("before, after, share", [
    ("0551234567", "055****567", 0.6), ("٠٥٥", "05*", 2 / 3), ("abc", "", 0.0), ("a", "abc", 1.0), ("+966551234567", "055****567", 0.0), ("966551", "965***", 1 / 3)])
def test_visible_fraction(spark, before, after, share):
    df = spark.createDataFrame([(before, after)], "b string, a string")
    assert df.select(scoring.visible_fraction(F.col("b"), F.col("a"))).first()[0] == pytest.approx(share)


def test_exposure_by_method(results):
    scored = vf.assess_risk(results["external"])
    exposure = {c: e for c, _, _, e in scored.exposures}
    assert exposure["customer_id"] == 0.25 and exposure["iban"] == 0.0 and exposure["customer_name_en"] == 0.10
    assert exposure["mobile"] == pytest.approx(0.10 + 0.70 * 0.4) and exposure["notes"] == pytest.approx(0.05)
    weights = {c: w for c, _, w, _ in scored.exposures}
    assert scored.direct_after == pytest.approx(55 * sum(weights[c] * e for c, e in exposure.items()) / sum(weights.values()))


def test_risk_falls_and_levels(results):
    scored = {p: vf.assess_risk(r) for p, r in results.items()}
    assert scored["external"].after < scored["developer"].after < scored["internal"].after < scored["internal"].before
    assert [risk.level(x) for x in (29.99, 30, 59.99, 60)] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert "Direct-identifier exposure fell from 55" in scored["external"].reasons()[0]


def test_utility_factors(results):
    useful = vf.assess_utility(results["external"])
    assert useful.factors["A"] == pytest.approx(14 / 18) and useful.factors["B"] == pytest.approx(14 / 18)
    rows = {c: rest for c, *rest in useful.columns}
    ages = [int(r[8]) for r in ROWS]
    assert rows["age"][2] == round(1 - 10 / (max(ages) - min(ages)), 2) and rows["age"][3] == 0.5
    bands = pd.Series([a // 10 * 10 + 5 for a in ages])
    numbers = pd.Series(ages)
    wanted = 1 - 0.5 * (min(1, abs(bands.mean() - numbers.mean()) / numbers.std()) + min(1, abs(bands.std() - numbers.std()) / numbers.std()))
    assert rows["age"][4] == round(wanted, 2)
    assert rows["district"][3:] == [0.0, 0.0] and rows["gender"][3:] == [1.0, 1.0]


def test_numeric_distribution_corner_cases():
    base = {"numbers_before": 5, "numbers_after": 5, "mean_before": 1.0, "mean_after": 1.0, "spread_before": 2.0, "spread_after": 2.0}
    assert numeric_distribution(base) == 1.0
    assert numeric_distribution(base | {"numbers_after": 0}) == 0.0
    assert numeric_distribution(base | {"spread_before": 0.0}) == 1.0
    assert numeric_distribution(base | {"numbers_after": 1, "spread_after": None}) == 0.5


def test_report_and_verdict(people, found, results):
    result = results["external"]
    counters = scoring.measure(result)
    scored, useful = vf.assess_risk(result, counters), vf.assess_utility(result, counters)
    lines = [r.text for r in vf.privacy_report(result, found, scored, useful, "people", 48).orderBy("line_no").collect()]
    titles = [t for t in lines if t.startswith("## ")]
    assert titles[:6] == ["## 1. Sensitive information detected", "## 2. Anonymization methods applied",
                          "## 3. Identifier status after anonymization", "## 4. Prototype Re-identification Risk",
                          "## 5. Data Utility", "## 6. Recommendations"]
    assert "- **Number of records:** 48  |  **Columns:** 18" in lines
    assert "| national_id | Direct | Suppression |" in lines
    assert vf.verdict(scored, useful).startswith("Privacy improved significantly")
    advice = vf.recommendations(result, scored, useful)
    assert "k < 3" in advice[0] and len(advice) >= 3


def test_recommendations_name_exposed_columns(people, found):
    plan = override_config(build_config(found, COLUMNS, "internal"), {"email": "Keep", "iban": "Keep"})
    result = anonymize(people, plan, found, "internal", KEY, salt="s")
    scored, useful = vf.assess_risk(result), vf.assess_utility(result)
    advice = vf.recommendations(result, scored, useful)
    assert "Column **email** is still strongly exposed (method: Keep). Use Suppression or Replacement." in advice[:3]
    assert "Direct identifiers left unchanged: email, iban." in advice
    assert any("or the 'AI / External Company' profile." in a for a in advice) and any("risk is still HIGH" in a for a in advice)
    assert scored.remaining == [("mobile", "Masking"), ("email", "Keep"), ("iban", "Keep")]


def test_compare_profiles(people, found, results):
    rows = {r.profile: r for r in vf.compare_profiles(people, found, COLUMNS, KEY, "s").collect()}
    for p, result in results.items():
        assert rows[p].risk_after == pytest.approx(vf.assess_risk(result).after)
        assert rows[p].utility == pytest.approx(vf.assess_utility(result).score)


def test_changed_columns_and_preview(results):
    result = results["external"]
    changed = {r.column for r in scoring.changed_columns(result.paired, COLUMNS).collect() if r.changed}
    # every job is common enough to stay
    assert changed == {t.column for t in result.treatments if t.method != "Keep"} - {"job"}
    shown = scoring.preview(result, ["age"], 5).collect()
    assert [r[KEY] for r in shown] == list(range(5)) and shown[0]["age__before"] == ROWS[0][8]


def test_risk_row_of_a_table_without_direct_columns():
    empty = risk.Risk([], [], risk.QuasiRisk(0.0, None, None), risk.QuasiRisk(0.0, None, None))
    assert empty.before == empty.after == 0.0
    assert empty.reasons() == ["No indirect identifiers were selected, so the quasi-identifier part is 0."]
    assert risk.exposure(Treatment("x", "Masking", "Direct", embedded=True), {"found_before": 0, "found_after": 0}) == 0.05


def test_many_columns_are_counted_in_bounded_jobs(spark):
    rng = random.Random(5)
    rows = [tuple(str(rng.randrange(1 + i % 4)) for i in range(12)) for _ in range(300)]
    columns = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    table = stage(risk.classes(df, columns), "classes")
    wanted = {", ".join(columns[i] for i in s): len({tuple(r[i] for i in s) for r in rows}) for s in itertools.combinations(range(12), 3)}
    assert {r.subset: r.classes for r in risk.subset_classes(table, columns).collect()} == wanted
    chosen = risk.known_subsets(columns)[5:9]
    assert {r.subset: r.classes for r in risk.subset_classes(table, columns, chosen=chosen).collect()} == {", ".join(s): wanted[", ".join(s)] for s in chosen}
    n = table.count()
    for at_once in (1 << 28, 40 * n):
        assert risk.all_subset_classes(table, columns, n, rows_at_once=at_once) == sum(wanted.values())
    exact, sketched = risk.quasi_risk(df, columns), risk.quasi_risk(df, columns, approximate=True)
    assert exact.average == pytest.approx(sum(wanted.values()) / len(wanted) / 300) and sketched.average == pytest.approx(exact.average, rel=0.05)
