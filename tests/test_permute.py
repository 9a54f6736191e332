"""Keyed permutations, and the fakes that are made with them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checks, fakes, permute

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("size", (1, 2, 3, 4))
def test_every_text_of_a_length_comes_once(spark, size):
    every = spark.range(10 ** size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("x"))
    made = {r[0] for r in every.select(permute.permute_digits(F.col("x"), "k")).collect()}
    assert made == {str(i).zfill(size) for i in range(10 ** size)}


def test_keys_and_lengths(apply):
    rng = random.Random(1)
    values = ["", *["".join(rng.choice("0123456789") for _ in range(n)) for n in (8, 18, 36, 37, 80)]]
    one, other = (apply(lambda c, k=k: permute.permute_digits(c, k), values) for k in "ab")
    assert [len(x) for x in one] == [len(x) for x in values] and one[0] == "" and all(x.isdigit() for x in one[1:])
    assert all(x != y != z for x, y, z in zip(values[1:], one[1:], other[1:])) and one[1:] != other[1:]
    tail = apply(lambda c: permute.permute_digits(c, "a"), ["1" * 37, "1" * 36 + "2"])
    assert len(set(tail)) == 2


def test_alphanumerics_keep_a_letter(spark):
    every = spark.range(36 ** 3).select(F.lpad(F.conv(F.col("id").cast("string"), 10, 36), 3, "0").alias("x")).where("x rlike '[A-Z]'")
    made = [r[0] for r in every.select(permute.permute_alphanumerics(F.col("x"), "k")).collect()]
    assert len(made) == len(set(made)) == 36 ** 3 - 1000 and all(len(x) == 3 and not x.isdigit() for x in made)


def iban(bank, account):
    rest = int("".join(str(int(c, 36)) for c in bank + account + "SA00")) % 97
    return f"SA{98 - rest:02d}{bank}{account}"


def test_different_identifiers_get_different_fakes(spark, apply):
    rng = random.Random(2)
    accounts = [f"{rng.randrange(10 ** 18):018d}" for _ in range(300)] + [f"{i:017d}A" for i in range(50)] + [f"A{i:017d}" for i in range(50)]
    ibans = [iban("80", a) for a in accounts]
    made = apply(lambda c: fakes.fake_iban(c, "s"), ibans)
    assert len(set(made)) == len(ibans) and all(m[4:6] == "80" and (m[6:].isdigit() == i[6:].isdigit()) for m, i in zip(made, ibans))
    assert all(apply(checks.iban_valid, made)) and all(apply(checks.iban_valid, ibans))
    assert apply(lambda c: fakes.fake_iban(c, "s"), [" ".join([ibans[0][:4], ibans[0][4:]])]) == [" ".join([made[0][:4], made[0][4:]])]
    broken = apply(lambda c: fakes.fake_iban(c, "s"), ["SA", "SA00", ibans[0][:-1] + "?", "no account"])
    assert len(broken) == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not supplied")
def test_all_subjects_keep_apart(spark):
    from catalog.queries import people
    df = people(spark, DATA).where("trim(national_id) <> ''")
    kinds = {"national_id": fakes.fake_national_id, "mobile": fakes.fake_mobile, "iban": fakes.fake_iban}
    plain = {"national_id": F.translate("national_id", "٠١٢٣٤٥٦٧٨٩", "0123456789"), "iban": F.replace(F.col("iban"), F.lit(" "), F.lit("")), "mobile": F.translate("mobile", "٠١٢٣٤٥٦٧٨٩", "0123456789")}
    pairs = df.select(*[x for c, f in kinds.items() for x in (plain[c].alias(c), (F.replace(f(F.col(c), "s"), F.lit(" "), F.lit("")) if c == "iban" else f(F.col(c), "s")).alias(f"{c}_fake"))])
    counts = pairs.agg(*[F.count_distinct(x).alias(x) for x in pairs.columns]).first()
    assert counts.national_id > 12_000 and all(counts[c] == counts[f"{c}_fake"] for c in kinds)
