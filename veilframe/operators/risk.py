"""Re-identification risk before and after treatment."""

import secrets
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.text import named
from veilframe.operators.lookup import class_sizes, look_up
from veilframe.operators.scoring import measure
from veilframe.plans.anonymize import Anonymized, Treatment
from veilframe.session import stage

ROWS_AT_ONCE = 1 << 28  # of 16 bytes, in one shuffle
SKETCHES = 128          # filled in one pass
SKETCH_SIZE = 14        # binary logarithm of the slots: about one per cent off


def level(score: float) -> str:
    if score < V.MEDIUM_RISK_AT:
        return "LOW"
    return "MEDIUM" if score < V.HIGH_RISK_AT else "HIGH"


# --------------------------------------------------------------------------- equivalence classes
def code(c: Column, key: str) -> Column:
    """A value as 64 bits that tell nothing without the key; equal values have equal codes, null has none."""
    return F.when(c.isNotNull(), F.xxhash64(F.lit(key), c.cast("string")))


def classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Size of every combination of values, null counting as a value; one shuffle of distinct combinations.

    Values become codes under a key that is drawn for each call, so a stored table of
    classes holds no originals, and its rows are of fixed width.
    """
    key = secrets.token_hex(16)
    coded = df.select(*[code(F.coalesce(named(c).cast("string"), F.lit(V.NULL_CLASS)), key).alias(c) for c in columns])
    return class_sizes(coded, columns)


def k_anonymity(class_table: DataFrame) -> DataFrame:
    """Smallest class, share of rows alone in their class, rows and classes."""
    size = F.col("class_size")
    return class_table.agg(
        F.min(size).alias("k"), F.try_divide(F.count_if(size == 1), F.sum(size)).alias("unique_share"),
        F.coalesce(F.sum(size), F.lit(0)).alias("rows"), F.count("*").alias("classes"))


def known_subsets(columns: list[str]) -> list[tuple[str, ...]]:
    """What an attacker may know: every choice of three columns (all, when fewer)."""
    return list(combinations(columns, min(V.KNOWN_ATTRIBUTES, len(columns))))


def subset_classes(class_table: DataFrame, columns: list[str], approximate: bool = False, chosen: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(subset, classes): how many classes each choice of columns makes, of all choices or the ``chosen`` ones.

    The mean of 1/k over rows is the number of classes over the number of rows,
    so counting distinct combinations is enough, and counting them among the
    classes of all columns reads no row twice.  Combinations are told by 64-bit
    hashes: of a thousand million, less than one is missed.
    """
    subsets = known_subsets(columns) if chosen is None else chosen
    if approximate:
        # sketches of a few kilobytes each, all filled in one pass and merged after it
        counts = class_table.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[named(c) for c in s]), SKETCH_SIZE)).alias(str(i))
            for i, s in enumerate(subsets)])
        pairs = [x for i, s in enumerate(subsets) for x in (F.lit(", ".join(s)), F.col(str(i)))]
        return counts.select(F.stack(F.lit(len(subsets)), *pairs).alias("subset", "classes"))
    n, size = len(columns), len(subsets[0])
    rows = class_table.select(F.array(*[named(c) for c in columns]).alias("v"))
    if chosen is None:
        place = F.lit(-1)
        for i in range(size):       # one explode for each place: the plan is the same for any number of columns
            rows = rows.withColumn(f"p{i}", F.explode(F.sequence(place + 1, F.lit(n - size + i))))
            place = F.col(f"p{i}")
    else:
        at = {c: i for i, c in enumerate(columns)}
        listed = ";".join(",".join(str(at[c]) for c in s) for s in chosen)
        rows = rows.withColumn("p", F.explode(F.transform(F.split(F.lit(listed), ";"), lambda x: F.split(x, ",").cast("array<int>"))))
        rows = rows.select("v", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(size)])
    places = [F.col(f"p{i}") for i in range(size)]
    names = F.array(*[F.lit(c) for c in columns])
    subset = F.concat_ws(", ", *[F.get(names, p) for p in places])
    present = rows.select(*[p.cast("smallint") for p in places], F.xxhash64(*[F.get("v", p) for p in places]).alias("h")).distinct()
    return present.groupBy(*[f"p{i}" for i in range(size)]).agg(F.count("*").alias("classes")).select(subset.alias("subset"), "classes")


def all_subset_classes(class_table: DataFrame, columns: list[str], classes_n: int, approximate: bool = False, rows_at_once: int = ROWS_AT_ONCE) -> int:
    """Classes of all choices of columns together.

    With many columns and classes, choices are counted in several jobs, so that none
    makes more than ``rows_at_once`` rows (or holds more than SKETCHES sketches);
    each gives one number.
    """
    subsets = known_subsets(columns)
    step = SKETCHES if approximate else max(1, rows_at_once // max(1, classes_n))
    parts = [None] if len(subsets) <= step else [subsets[i:i + step] for i in range(0, len(subsets), step)]
    return sum(subset_classes(class_table, columns, approximate, part).agg(F.sum("classes")).first()[0] or 0 for part in parts)


@dataclass
class QuasiRisk:
    """Average chance of re-identification, smallest class, and share of unique rows."""
    average: float
    k: int | None
    unique: float | None


def quasi_risk(df: DataFrame, columns: list[str], approximate: bool = False) -> QuasiRisk:
    if not columns:
        return QuasiRisk(0.0, None, None)
    table = stage(classes(df, columns), "classes")
    total = k_anonymity(table).first()
    if not total["rows"]:
        return QuasiRisk(0.0, None, None)
    if len(columns) <= V.KNOWN_ATTRIBUTES:
        average = total["classes"] / total["rows"]
    else:
        average = all_subset_classes(table, columns, total["classes"], approximate) / len(known_subsets(columns)) / total["rows"]
    return QuasiRisk(average, total["k"], total["unique_share"])


def class_size_per_row(df: DataFrame, row_key: str, columns: list[str], **options) -> DataFrame:
    """Each row with the size of its class, for looking into single rows.

    The sizes are counted first and looked up, because a window over the classes
    would bring all rows of a large class together in one task.
    """
    filled = [F.coalesce(named(c).cast("string"), F.lit(V.NULL_CLASS)) for c in columns]
    # length-prefixed, so different combinations never make the same text
    combined = F.concat(*[x for c in filled for x in (F.length(c).cast("string"), F.lit(":"), c)])
    keyed = df.select(named(row_key), *[named(c) for c in columns], combined.alias("__class"))
    sizes = stage(keyed.groupBy(F.col("__class").alias("value")).agg(F.count("*").alias("payload")), "class-sizes")
    mapping = sizes.withColumn("n_rows", F.col("payload"))
    return look_up(keyed, F.col("__class"), mapping, row_key, "class_size", **options).drop("__class")


# --------------------------------------------------------------------------- score
def exposure(t: Treatment, counters: dict) -> float:
    """How much of a direct identifier can still be read."""
    if t.method != "Masking":
        return V.METHOD_EXPOSURE.get(t.method, 1.0)
    if t.embedded:
        base, slope = V.MASK_EXPOSURE_EMBEDDED
        found = counters.get("found_before") or 0
        left = min(1.0, counters["found_after"] / found) if found else 0.0
    else:
        base, slope = V.MASK_EXPOSURE_WHOLE
        left = counters.get("visible") or 0.0
    return base + slope * left


@dataclass
class Risk:
    """Risk before and after; ``exposures`` has (column, method, weight, exposure) of direct identifiers."""
    exposures: list[tuple[str, str, float, float]]
    quasi_columns: list[str]
    quasi_before: QuasiRisk
    quasi_after: QuasiRisk

    @property
    def direct_before(self) -> float:
        return float(V.DIRECT_MAX) if self.exposures else 0.0

    @property
    def direct_after(self) -> float:
        weight = sum(w for _, _, w, _ in self.exposures)
        return V.DIRECT_MAX * sum(w * e for _, _, w, e in self.exposures) / weight if weight else 0.0

    @property
    def before(self) -> float:
        return self.direct_before + V.QUASI_MAX * self.quasi_before.average

    @property
    def after(self) -> float:
        return self.direct_after + V.QUASI_MAX * self.quasi_after.average

    @property
    def remaining(self) -> list[tuple[str, str]]:
        """(column, method) of direct identifiers that are still largely readable."""
        return [(c, m) for c, m, _, e in self.exposures if round(e, 2) >= V.STILL_EXPOSED_AT]

    def reasons(self) -> list[str]:
        said, lines = V.RISK_REASONS, []
        b, a = self.quasi_before, self.quasi_after
        if self.exposures:
            lines.append(said["direct"].format(before=self.direct_before, after=self.direct_after, most=V.DIRECT_MAX,
                                               columns=len(self.exposures)))
        if not self.quasi_columns:
            lines.append(said["no_quasi"])
        elif b.k is not None:
            lines.append(said["quasi"].format(
                columns=", ".join(self.quasi_columns), before=b.average, after=a.average, most=V.QUASI_MAX,
                part_before=V.QUASI_MAX * b.average, part_after=V.QUASI_MAX * a.average))
            lines.append(said["unique"].format(before=b.unique, after=a.unique, k_before=b.k, k_after=a.k))
        if self.remaining:
            lines.append(said["exposed"].format(columns=", ".join(c for c, _ in self.remaining)))
        return lines

    def table(self, spark) -> DataFrame:
        """One row with all figures."""
        b, a = self.quasi_before, self.quasi_after
        return spark.createDataFrame([(
            self.before, self.after, round(self.before), round(self.after), level(self.before), level(self.after),
            self.direct_before, self.direct_after, V.QUASI_MAX * b.average, V.QUASI_MAX * a.average,
            b.average, a.average, b.k, a.k, b.unique, a.unique)],
            "before_exact double, after_exact double, before int, after int, level_before string, level_after string, "
            "direct_before double, direct_after double, quasi_before double, quasi_after double, "
            "avg_reid_before double, avg_reid_after double, k_before bigint, k_after bigint, "
            "unique_before double, unique_after double")

    def exposure_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(c, m, w, 1.0, round(e, 2)) for c, m, w, e in self.exposures],
            "column string, method string, weight double, exposure_before double, exposure_after double")


def assess_risk(result: Anonymized, counters: dict | None = None, approximate: bool = False,
                quasi_before: QuasiRisk | None = None) -> Risk:
    """Risk of a treated table.  ``quasi_before`` saves recounting an input scored already."""
    counters = measure(result) if counters is None else counters
    quasi = quasi_columns(result.treatments)
    if quasi_before is None:
        quasi_before = quasi_risk(result.source, quasi, approximate)
    return risk_of(result.treatments, counters, quasi_before, quasi_risk(result.data, quasi, approximate))


def quasi_columns(treatments: list[Treatment]) -> list[str]:
    return [t.column for t in treatments if t.category == "Indirect"]


def risk_of(treatments: list[Treatment], counters: dict, quasi_before: QuasiRisk, quasi_after: QuasiRisk) -> Risk:
    """Risk from counters by column and the risk of the indirect identifiers."""
    direct = [(t.column, t.method, V.DIRECT_WEIGHTS.get(t.entity, V.DEFAULT_DIRECT_WEIGHT),
               exposure(t, counters.get(t.column, {}))) for t in treatments if t.category == "Direct"]
    return Risk(direct, quasi_columns(treatments), quasi_before, quasi_after)
