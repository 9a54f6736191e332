"""What scores need to know about a table before and after treatment, as aggregates that one write can gather.

``DataFrame.observe`` computes them in the tasks that write the treated table, so
originals are compared with what became of them without ever being stored.
"""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from veilframe import fixed_values as V
from veilframe.functions.numbers import band_midpoint, parse_number
from veilframe.functions.spans import count_spans
from veilframe.functions.text import let, named, normalize_digits

#: What is measured of a treated column beside what is measured of all.
VISIBLE, SPANS, NUMBERS = "visible", "spans", "numbers"
ROWS = "rows"


def visible_fraction(before: Column, after: Column) -> Column:
    """Share of the original characters that still stand at their place; null for empty originals."""
    def share(original):
        same = F.filter(F.zip_with(F.split(original, ""), F.split(after, ""), lambda x, y: x == y), lambda s: s)
        return F.when(original != "", F.least(F.lit(1.0), F.size(same) / F.length(original)))
    return F.when(after.isNotNull(), let(normalize_digits(before), share))


class Counters:
    """Counters of pairs (column before, column after), each under a name of the caller's choice, gathered while a table is written."""

    def __init__(self, pairs: dict[str, tuple[str, str, str | None]]):
        self.observation = Observation()
        self.aggregates = [F.count(F.lit(1)).alias(ROWS)]
        self.places: dict[tuple, str] = {}
        self.fields = {name: {field: self._place(what) for field, what in self._wanted(*pair).items()} for name, pair in pairs.items()}

    def _wanted(self, before: str, after: str, measure: str | None) -> dict[str, tuple]:
        """What is counted, as (function, columns): what several pairs want is counted once."""
        found: dict[str, tuple] = {"removed": ("removed", after), "changed": ("changed", before, after)}
        if measure == VISIBLE:
            found["visible"] = (VISIBLE, before, after)
        if measure == SPANS:
            found |= {"found_before": (SPANS, before), "found_after": (SPANS, after)}
        if measure == NUMBERS:
            found |= {f"{f}_{side}": (f, side, c) for side, c in (("before", before), ("after", after)) for f in ("numbers", "mean", "spread")}
        return found

    def _place(self, what: tuple) -> str:
        if what not in self.places:
            self.places[what] = f"m{len(self.places)}"
            self.aggregates.append(self._aggregate(*what).alias(self.places[what]))
        return self.places[what]

    @staticmethod
    def _aggregate(kind: str, *columns: str) -> Column:
        if kind in ("numbers", "mean", "spread"):
            side, c = columns
            number = parse_number(named(c)) if side == "before" else band_midpoint(named(c))
            return {"numbers": F.count, "mean": F.avg, "spread": F.stddev_samp}[kind](number)
        one, other = named(columns[0]), named(columns[-1])
        if kind == "removed":
            return F.count_if(one.eqNullSafe(V.REMOVED))
        if kind == "changed":
            return F.bool_or(~one.eqNullSafe(other))
        return F.avg(visible_fraction(one, other)) if kind == VISIBLE else F.coalesce(F.sum(count_spans(one)), F.lit(0))

    def watch(self, df: DataFrame) -> DataFrame:
        """``df``, whose next write gathers the counters."""
        return df.observe(self.observation, *self.aggregates)

    def read(self) -> dict[str, dict]:
        """Counters by name, once the write is done; none for a table without rows."""
        got = self.observation.get
        if not got.get(ROWS):
            return {}
        return {name: {"cells": got[ROWS]} | {field: got[place] for field, place in own.items()} for name, own in self.fields.items()}
