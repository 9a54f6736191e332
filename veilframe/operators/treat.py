"""Treatments as columns, and the whole-table figures some of them need."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.fakes import STATELESS_FAKES
from veilframe.functions.masks import mask_free_text, mask_value
from veilframe.functions.numbers import band_label, looks_like_date, nearest_width, parse_number
from veilframe.functions.text import is_blank, named, normalize_digits, region_of_city, strip


# --------------------------------------------------------------------------- treatments of one value
def _unless_blank(c: Column, treated: Column) -> Column:
    """Null and blank cells stay as they are."""
    return F.when(c.isNull() | is_blank(c), c).otherwise(treated)


def mask(c: Column, entity: str | None, embedded: bool, strength: str) -> Column:
    return _unless_blank(c, mask_free_text(c, strength) if embedded else mask_value(c, entity, strength))


def suppress(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(V.REMOVED))


HASH_LENGTH = 32        # hexadecimal characters, 128 bits


def hash_value(c: Column, salt: str, length: int = HASH_LENGTH) -> Column:
    """Salted one-way pseudonym.  Ten characters are 40 bits and collide beyond a million distinct values."""
    return F.concat(F.lit("H_"), F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, length))


def needs_numbers(entity: str | None, format_preserving: bool) -> bool:
    """Whether a replacement counts the distinct values of the column."""
    return not (format_preserving and entity in STATELESS_FAKES)


def numbered_pseudonym(number: Column, entity: str | None, format_preserving: bool) -> Column:
    digits = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    if format_preserving and entity == "EMAIL_ADDRESS":
        return F.concat(F.lit("user"), digits, F.lit("@example.com"))
    return F.concat(F.lit(V.PSEUDONYM_PREFIXES.get(entity, V.DEFAULT_PREFIX) + "_"), digits)


def replace_stateless(c: Column, entity: str, salt: str) -> Column:
    return _unless_blank(c, STATELESS_FAKES[entity](c, salt))


def replace_numbered(c: Column, number: Column, entity: str | None, format_preserving: bool) -> Column:
    return _unless_blank(c, numbered_pseudonym(number, entity, format_preserving))


def generalize_numeric(c: Column, width: Column, strict: bool = False) -> Column:
    """Band of a number; text that is no number stays (or goes, when strict)."""
    number = parse_number(c)
    left = suppress(c) if strict else c
    return F.when(number.isNotNull(), band_label(number, width)).otherwise(left)


def generalize_date(c: Column, strong: bool, strict: bool = False) -> Column:
    """Year, or decade when strong; text without a year stays (or goes, when strict)."""
    year = F.regexp_extract(normalize_digits(c), r"([0-9]{4})", 1)
    number = year.try_cast("int")
    shown = F.concat((F.floor(number / 10) * 10).cast("string"), F.lit("s")) if strong else number.cast("string")
    return F.when(year != "", shown).otherwise(suppress(c) if strict else c)


def generalize_address(c: Column) -> Column:
    """The neighbourhood, when the address names one."""
    found = F.regexp_extract(c, V.ADDRESS_AREA, 0)
    return F.when(c.isNotNull(), F.when(found != "", strip(found)).otherwise(V.ADDRESS_GENERALIZED))


def city_region(c: Column) -> Column:
    return F.coalesce(region_of_city(c), F.lit(V.OTHER))


def merge_rare(c: Column, kept: list[str]) -> Column:
    return F.when(c.isNull() | c.isin(kept), c).otherwise(V.OTHER) if kept else F.when(c.isNotNull(), V.OTHER)


# --------------------------------------------------------------------------- figures over the table
def column_figures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: shares of numbers and dates, range, and how many cities are known.

    One pass over all columns; one row per column comes out.
    """
    long = df.select(*[named(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [named(c) for c in columns], "column", "raw")
    read = long.select("column", "raw", strip(F.col("raw")).alias("value"), parse_number(F.col("raw")).alias("number"))
    filled = F.col("value") != ""
    return read.groupBy("column").agg(
        F.count("raw").alias("present"), F.count_if(filled).alias("filled"), F.count("number").alias("numbers"),
        F.count_if(filled & looks_like_date(F.col("value"))).alias("dates"),
        F.count_if(F.col("raw").isNotNull() & region_of_city(F.col("raw")).isNotNull()).alias("regions"),
        F.min("number").alias("low"), F.max("number").alias("high"),
        F.avg("number").alias("mean"), F.stddev_samp("number").alias("spread"))


def column_kinds(figures: DataFrame) -> DataFrame:
    """``numeric``, ``date`` or ``text`` per column."""
    share = V.KIND_SHARE
    kind = (F.when(F.try_divide("numbers", "filled") >= share, "numeric")
            .when(F.try_divide("dates", "filled") >= share, "date").otherwise("text"))
    return figures.withColumn("kind", kind)


def band_widths(figures: DataFrame, target_bins: dict[str, int]) -> DataFrame:
    """``width_<name>`` for each number of bands a range may be cut into."""
    return figures.select("*", *[nearest_width(F.col("low"), F.col("high"), F.lit(bins)).alias(f"width_{name}")
                                 for name, bins in target_bins.items()])


def enough_rows(present: int, min_group_frac: float) -> int:
    """Rows that a category needs to be kept, of a column with so many that are not null."""
    return max(2, math.ceil(min_group_frac * present))


def common_categories(df: DataFrame, present: dict[str, int], min_group_frac: float) -> DataFrame:
    """(column, value, n_rows) frequent enough to be kept as they are.

    ``present`` gives the non-null count of each column.  A kept value has at
    least that share of them, so at most ``1 / min_group_frac`` per column remain.
    """
    columns = list(present)
    long = df.select(*map(named, columns)).unpivot([], [named(c) for c in columns], "column", "value").where("value is not null")
    enough = F.lit(None).cast("bigint")
    for column, n in present.items():
        enough = F.when(F.col("column") == column, enough_rows(n, min_group_frac)).otherwise(enough)
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") >= enough)
