"""Counters over a treated table that risk and utility share.

They are gathered while the treated table is written.  For a result that was not
written, and for looking into single columns, pairs of originals and treated cells
are stacked to (column, before, after), and one aggregation leaves one row per column.
"""

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.numbers import band_midpoint, parse_number
from veilframe.functions.spans import count_spans
from veilframe.functions.text import named
from veilframe.operators.counters import NUMBERS, SPANS, VISIBLE, visible_fraction
from veilframe.plans.anonymize import BEFORE, Anonymized


def stack_pairs(paired: DataFrame, columns: list[str]) -> DataFrame:
    """(column, before, after) for each cell of the named columns."""
    pairs = [F.struct(named(c + BEFORE).alias("before"), named(c).alias("after")).alias(c)
             for c in columns]
    return paired.select(*pairs).unpivot([], [named(c) for c in columns], "column", "pair").select(
        "column", "pair.before", "pair.after")


def _in(columns: list[str]) -> Column:
    return F.col("column").isin(columns) if columns else F.lit(False)


def pair_counters(paired: DataFrame, columns: list[str], masked: list[str], masked_text: list[str],
                  banded: list[str]) -> DataFrame:
    """One row per column.  Costly measures are taken only for the columns that need them."""
    before, after = F.col("before"), F.col("after")
    pairs = stack_pairs(paired, columns).select(
        "column", "before", "after",
        F.when(_in(masked), visible_fraction(before, after)).alias("visible"),
        F.when(_in(masked_text), count_spans(before)).alias("found_before"),
        F.when(_in(masked_text), count_spans(after)).alias("found_after"),
        F.when(_in(banded), parse_number(before)).alias("number_before"),
        F.when(_in(banded), band_midpoint(after)).alias("number_after"))
    return pairs.groupBy("column").agg(
        F.count("*").alias("cells"),
        F.count_if(after.eqNullSafe(V.REMOVED)).alias("removed"),
        F.bool_or(~before.eqNullSafe(after)).alias("changed"),
        F.avg("visible").alias("visible"),
        F.coalesce(F.sum("found_before"), F.lit(0)).alias("found_before"),
        F.coalesce(F.sum("found_after"), F.lit(0)).alias("found_after"),
        *[f(f"number_{side}").alias(f"{name}_{side}") for side in ("before", "after")
          for name, f in (("numbers", F.count), ("mean", F.avg), ("spread", F.stddev_samp))])


def distinct_values(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many different values each column has, nulls not counted; repeats collapse before the shuffle."""
    cells = df.select(*map(named, columns)).unpivot([], [named(c) for c in columns], "column", "value").where("value is not null")
    counts = cells.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("n"))
    return {r["column"]: r["n"] for r in counts.collect()}


def measure(result: Anonymized) -> dict[str, dict]:
    """Counters by column, as plan-sized data: one row per column of the header.  They are taken once for each result."""
    if result.counters is None:
        of = lambda what: [t.column for t in result.treatments if t.measure == what]
        rows = pair_counters(result.paired, result.columns, of(VISIBLE), of(SPANS), of(NUMBERS)).collect()
        result.counters = {r["column"]: r.asDict() for r in rows}
    counted = [t.column for t in result.treatments if t.counts_values and "distinct_before" not in result.counters.get(t.column, {})]
    if counted and result.counters:
        before, after = distinct_values(result.source, counted), distinct_values(result.data, counted)
        for c in counted:
            result.counters[c] |= {"distinct_before": before.get(c, 0), "distinct_after": after.get(c, 0)}
    return result.counters


def changed_columns(paired: DataFrame, columns: list[str]) -> DataFrame:
    """(column, changed) for each column."""
    pairs = stack_pairs(paired, columns)
    return pairs.groupBy("column").agg(
        F.bool_or(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


def preview(result: Anonymized, columns: list[str], rows: int) -> DataFrame:
    """The first rows by row key, as they were and as they are."""
    key = named(result.row_key)
    shown = [x for c in columns for x in (named(c + BEFORE), named(c))]
    first = result.data.select(key, *map(named, columns)).orderBy(key).limit(rows)
    before = result.source.select(key.alias("__key"), *[named(c).alias(c + BEFORE) for c in columns])
    return before.join(F.broadcast(first), key.eqNullSafe(F.col("__key"))).select(key, *shown).orderBy(key).limit(rows)
