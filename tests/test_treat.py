import hashlib
import random

import pytest
from pyspark.sql import functions as F

import veilframe as vf
from tests.people import COLUMNS, ROWS, luhn_ok
from veilframe.functions import checks, fakes
from veilframe.operators import lookup, treat
from veilframe.plans.anonymize import anonymize
from veilframe.plans.config import build_config
from veilframe.session import stage

KEY = "row_id"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join([f"{KEY} bigint", *[f"{c} string" for c in COLUMNS]])).repartition(3).cache()


@pytest.fixture(scope="module")
def found(people):
    return vf.detect(people, KEY).cache()


def treated(people, found, profile, **options):
    return anonymize(people, build_config(found, COLUMNS, profile), found, profile, KEY, salt="s", **options)


def test_suppress_and_hash_treat_blank_cells(apply):
    assert apply(treat.suppress, ["x", "", "  ", None]) == ["[REMOVED]"] * 3 + [None]
    wanted = ["H_" + hashlib.sha256(("salt" + v).encode()).hexdigest()[:32] for v in ("x", "", "هند")]
    assert apply(lambda c: treat.hash_value(c, "salt"), ["x", "", "هند", None]) == wanted + [None]


def test_masks_and_replacements_leave_blank_cells(apply):
    for f in (lambda c: treat.mask(c, "EMAIL_ADDRESS", False, "strong"), lambda c: treat.mask(c, None, True, "strong"),
              *[lambda c, e=e: treat.replace_stateless(c, e, "s") for e in fakes.STATELESS_FAKES]):
        assert apply(f, ["", "  ", None]) == ["", "  ", None]


def test_generalisations(apply):
    numbers = ["23", "8,700", "٢٣", "-3", "n/a", None, "100"]
    assert apply(lambda c: treat.generalize_numeric(c, F.lit(5.0)), numbers) == [
        "20–25", "8,700–8,705", "20–25", "-5–0", "n/a", None, "100–105"]
    assert apply(lambda c: treat.generalize_numeric(c, F.lit(5.0), True), ["n/a", "7"]) == ["[REMOVED]", "5–10"]
    assert apply(lambda c: treat.generalize_date(c, True), ["1994-03-01", "01/02/2007", "٢٠١٥", "soon", None]) == [
        "1990s", "2000s", "2010s", "soon", None]
    assert apply(lambda c: treat.generalize_date(c, False), ["1994-03-01", "x1234567"]) == ["1994", "1234"]
    assert apply(treat.generalize_address, ["حي الروضة، شارع 5", "حي العليا الشمالية، x", "12 Al Olaya District, Riyadh", "King Road", None]) == [
        "حي الروضة", "حي العليا الشمالية", "Al Olaya District", "[GENERALIZED ADDRESS]", None]
    assert apply(treat.city_region, ["Riyadh", "جدة", "Paris", None]) == ["Central Region", "Western Region", "Other", "Other"]


def test_merge_rare(spark):
    values = ["a"] * 10 + ["b"] * 5 + ["c"] * 2 + ["d"] + [None] * 4
    df = spark.createDataFrame([(v,) for v in values], "v string")
    kept = lambda frac: sorted(r.value for r in treat.common_categories(df, {"v": 18}, frac).collect())
    assert kept(0.10) == ["a", "b", "c"] and kept(0.2) == ["a", "b"] and kept(0.01) == ["a", "b", "c"] and kept(0.9) == []
    out = df.select(treat.merge_rare(F.col("v"), ["a", "b"])).collect()
    assert sorted({str(r[0]) for r in out}) == ["None", "Other", "a", "b"]


@pytest.mark.parametrize("broadcast_bytes", [lookup.BROADCAST_BYTES, 0])
def test_numbering_in_order_of_appearance_with_a_hot_value(spark, broadcast_bytes):
    rng = random.Random(1)
    values = [rng.choice(["hot"] * 20 + [f"v{k}" for k in range(30)] + [None, "", " "]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, v string").repartition(5)
    df = df.withColumn("w", F.upper("v"))
    numbers = stage(lookup.first_seen_numbers(df, KEY, ["v", "w"]), "numbers")
    joined = lookup.attach_numbers(df, KEY, ["v", "w"], numbers, broadcast_bytes).orderBy(KEY)
    rows = joined.select(*[treat.replace_numbered(F.col(c), F.col(f"__number_{c}"), "CUSTOMER_ID", False).alias(c) for c in "vw"]).collect()
    out = [r.v for r in rows]
    assert out == [r.w for r in rows]
    seen, wanted = {}, []
    for v in values:
        if v is None or not v.strip():
            wanted.append(v)
        else:
            wanted.append(f"Customer_{seen.setdefault(v, len(seen) + 1):03d}")
    assert out == wanted


def test_numbers_beyond_three_digits(spark):
    df = spark.range(1500).select(F.col("id").alias(KEY), F.concat(F.lit("v"), F.col("id")).alias("v"))
    out = {r.value: r.number for r in lookup.first_seen_numbers(df, KEY, ["v"]).collect()}
    assert out == {f"v{i}": i + 1 for i in range(1500)}
    shown = treat.numbered_pseudonym(F.lit(1234), None, False), treat.numbered_pseudonym(F.lit(7), "EMAIL_ADDRESS", True)
    assert list(spark.range(1).select(*shown).first()) == ["Value_1234", "user007@example.com"]


def test_large_lookup_sends_hot_rows_apart(spark):
    df = spark.range(4000).select(F.col("id").alias(KEY), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    mapping = df.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n_rows"), F.max(KEY).alias("payload"))
    joined = lookup.look_up(df, F.col("v"), stage(mapping, "m"), KEY, "n", 0)
    assert joined.where("v = 'hot' and n = 3999").count() == 1334 and joined.where("n is null").count() == 0


def test_fakes_are_valid_consistent_and_alike(apply):
    ids = [r[3] for r in ROWS] + ["٢٠٠٠٠٠٠٠٠٦", "9"]
    made = apply(lambda c: fakes.fake_national_id(c, "s"), ids)
    assert all(luhn_ok(m) and len(m) == 10 for m in made)
    assert [m[0] for m in made] == [r[3][0] for r in ROWS] + ["2", "1"]
    assert made == apply(lambda c: fakes.fake_national_id(c, "s"), ids) != apply(lambda c: fakes.fake_national_id(c, "t"), ids)
    mobiles = ["0551234567", "+966 55-123 4567", "00966551234567", "٠٥٥١٢٣٤٥٦٧"]
    out = apply(lambda c: fakes.fake_mobile(c, "s"), mobiles)
    assert [o[:k] for o, k in zip(out, (2, 6, 6, 2))] == ["05", "+966 5", "009665", "05"]
    assert out[1][7] == "-" and out[1][11] == " " and [len(o) for o in out] == [len(m) for m in mobiles]
    ibans = [r[6] for r in ROWS]
    out = apply(lambda c: fakes.fake_iban(c, "s"), ibans)
    assert all(apply(checks.iban_valid, out))
    assert [[ch == " " for ch in o] for o in out] == [[ch == " " for ch in i] for i in ibans]
    assert all(o.replace(" ", "")[4:6] == "80" and o != i for o, i in zip(out, ibans))
    names = apply(lambda c: fakes.fake_name(c, "s"), ["خالد بن علي الزهراني", "Ali Omar", "One", "A B C"])
    assert names[0].split()[1] == "بن" and len(names[1].split()) == 2 and len(names[2].split()) == 2 and names[3].split()[1] == "bin"


def test_column_kinds_and_widths(spark):
    rows = [("1", "1990-01-02", "a", None), ("2,000", "1991-2-3", "2", None), ("x", "", "b", " ")] + [("7", "1.1.1", "c", "")] * 10
    figures = treat.column_kinds(treat.column_figures(spark.createDataFrame(rows, "n string, d string, t string, e string"), list("ndte")))
    assert {r.column: r.kind for r in figures.collect()} == {"n": "numeric", "d": "date", "t": "text", "e": "text"}


def test_anonymize_external(people, found):
    result = treated(people, found, "external")
    rows = {r[KEY]: r for r in result.data.collect()}
    assert len(rows) == 48 and result.data.columns == [KEY, *COLUMNS]
    first = rows[0]
    assert first.customer_name_ar == "Person_001" and first.national_id == first.iban == first.district == "[REMOVED]"
    assert first.email == "u***@***.com" and first.mobile[:2] + first.mobile[-2:] == ROWS[0][4][:2] + ROWS[0][4][-2:]
    assert first.city == "Western Region" and first.gender == ROWS[0][9] and first.order_ref == ROWS[0][16]
    assert first.notes == f"رقم الهوية: ********{ROWS[0][3][-2:]}" and rows[46].notes == "12 boxes"
    assert {t.column: t.width for t in result.treatments if t.width} == {"age": 10.0, "salary": 5000.0}


def test_developer_profile_is_format_preserving(people, found):
    rows = treated(people, found, "developer").data.orderBy(KEY).collect()
    assert all(luhn_ok(r.national_id) for r in rows) and rows[6].email == "user007@example.com"
    assert len({r.national_id for r in rows}) == 48 and rows[0].city == ROWS[0][10]


def test_large_and_small_maps_give_the_same_table(people, found):
    from veilframe.plans.anonymize import apply_treatments, resolve_treatments
    treatments = resolve_treatments(build_config(found, COLUMNS, "external"), found)
    treatments = [t for t in treatments if t.method != "Generalization"]
    tables = [apply_treatments(people, treatments, vf.PROFILES["external"], "s", KEY, broadcast_bytes=b).orderBy(KEY).collect()
              for b in (0, 1 << 25)]
    assert tables[0] == tables[1]


def test_hash_length(people, found):
    config = build_config(found, COLUMNS, "external")
    data = anonymize(people, config, found, "external", KEY, hash_length=10, staged=False).data
    assert data.where("customer_id rlike '^H_[0-9a-f]{10}$'").count() == 48


def test_random_salt_and_lazy_result(people, found):
    config = build_config(found, COLUMNS, "external")
    a, b = (anonymize(people, config, found, "external", KEY, staged=False).data.orderBy(KEY).first().customer_id for _ in range(2))
    assert a != b


def test_empty_and_single_row(people, found):
    for n in (0, 1):
        result = treated(people.orderBy(KEY).limit(n), found, "external")
        risk, utility = vf.assess_risk(result), vf.assess_utility(result)
        assert result.data.count() == n and 0 <= risk.after <= 100 and 0 <= utility.score <= 100
        if n == 0:
            assert risk.quasi_after.average == 0.0 and utility.factors["B"] == 1.0


def test_numbers_do_not_depend_on_keys_or_map_size(spark):
    rows = [(1, "a", "p"), (1, "b", "q"), (2, "a", "p"), (3, "c", None), (None, "b", "q"), (4, None, "r")]
    for key in ("bigint", "string"):
        df = spark.createDataFrame(rows, "k bigint, `x.y` string, z string").withColumn("k", F.col("k").cast(key))
        numbers = lookup.first_seen_numbers(df, "k", ["x.y", "z"])
        by_value = {(r["column"], r["value"]): r["number"] for r in numbers.collect()}
        assert sorted(v for (c, _), v in by_value.items() if c == "x.y") == [1, 2, 3]
        for size in (0, 70, 1 << 25):
            out = lookup.attach_numbers(df, "k", ["x.y", "z"], numbers, size).collect()
            assert len(out) == len(rows)
            assert all(r["__number_x.y"] == by_value.get(("x.y", r["x.y"])) and r["__number_z"] == by_value.get(("z", r["z"])) for r in out)


def test_any_header(spark):
    names = ["job.title", "seg`ment", "الاسم", "row_key", "value", "column"]
    df = spark.createDataFrame([(i, *[f"{n[:3]}{i % 4}" for n in names]) for i in range(40)], "id bigint, a string, b string, c string, d string, e string, f string") \
        .toDF("id", *names)
    found = vf.detect(df, "id")
    config = build_config(found, names, "external")
    methods = dict(zip(names, ["Replacement", "Generalization", "Hashing", "Masking", "Suppression", "Replacement"]))
    config = vf.override_config(config, methods, {n: "Indirect" for n in names[:4]})
    with vf.scratch(spark):
        result = anonymize(df, config, found, "external", "id")
        risk = vf.assess_risk(result)
        assert result.data.columns == ["id", *names] and result.data.count() == 40 and risk.quasi_after.k >= 1
        assert vf.assess_utility(result).score >= 0


def test_equal_values_get_equal_fakes_with_even_digits(spark):
    from veilframe.functions import fakes
    df = spark.range(4000).select(F.concat(F.lit("1"), F.lpad((F.col("id") % 2000).cast("string"), 9, "0")).alias("v"))
    rows = df.select("v", fakes.fake_national_id(F.col("v"), "s").alias("f")).distinct().collect()
    assert len(rows) == 2000
    counts = [sum(r.f[p] == str(d) for r in rows for p in range(1, 9)) for d in range(10)]
    assert max(counts) < 1.15 * min(counts)


def test_strict_leaves_no_domain_and_no_free_text(people, found):
    config = build_config(found, COLUMNS, "internal")
    row = anonymize(people, config, found, "internal", KEY, strict=True, staged=False).data.orderBy(KEY).first()
    assert "example.com" not in row.email and row.email.endswith(".com") and row.notes == "[REMOVED]"
