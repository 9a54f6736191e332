"""How useful the treated table still is."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from veilframe import fixed_values as V
from veilframe.operators.scoring import measure
from veilframe.plans.anonymize import Anonymized, Treatment

def numeric_precision(t: Treatment) -> float | None:
    """Of numeric columns: how fine the values still are."""
    if t.kind != "numeric":
        return None
    if t.method == "Generalization":
        spread = (t.high - t.low) or 1
        return max(0.0, 1 - t.width / spread)
    return {"Keep": 1.0, "Suppression": 0.0, "Masking": 0.3}.get(t.method, 0.2)


def type_kept(t: Treatment) -> float:
    if t.method in ("Keep", "Suppression"):
        return 1.0 if t.method == "Keep" else 0.0
    if t.kind != "numeric":
        return 1.0
    return 0.5 if t.method == "Generalization" else 0.0


def numeric_distribution(c: dict) -> float:
    """Mean and spread of the bands against those of the numbers."""
    if not c["numbers_after"]:
        return 0.0
    spread = c["spread_before"]
    if not c["numbers_before"] or spread == 0:
        return 1.0
    if spread is None:          # a single number has no spread to compare with
        return 1 - 0.5 * (1.0 + 1.0)
    mean_shift = min(1.0, abs(c["mean_after"] - c["mean_before"]) / spread)
    spread_shift = min(1.0, abs(c["spread_after"] - spread) / spread) if c["numbers_after"] > 1 else 1.0
    return 1 - 0.5 * (mean_shift + spread_shift)


def distribution_kept(t: Treatment, counters: dict) -> float:
    if t.method in ("Keep", "Suppression"):
        return 1.0 if t.method == "Keep" else 0.0
    if t.kind == "numeric":
        return numeric_distribution(counters) if t.method == "Generalization" else 0.0
    if t.method == "Generalization":
        return min(1.0, counters.get("distinct_after", 0) / max(counters.get("distinct_before", 0), 1))
    return 0.8 if t.method in ("Hashing", "Replacement") else 0.3


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 1.0


@dataclass
class Utility:
    """Factors A to E, and per analytical column (column, method, precision, type, distribution)."""
    factors: dict[str, float]
    columns: list[tuple]

    @property
    def score(self) -> float:
        return 100 * sum(V.UTILITY_WEIGHTS[f] * v for f, v in self.factors.items())

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.score, round(self.score), *self.factors.values())],
            "score_exact double, score int, A double, B double, C double, D double, E double")

    def factor_rows(self) -> list[tuple[str, str, str]]:
        """(factor, weight, value) as shown."""
        return [(f"{f}  {V.UTILITY_FACTORS[f]}", f"{V.UTILITY_WEIGHTS[f]:.0%}", f"{v:.0%}")
                for f, v in self.factors.items()]

    def factor_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.factor_rows(), "factor string, weight string, value string")

    def column_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.columns, "column string, method string, role string, numeric_precision double, "
                          "type_kept double, distribution_kept double")


def assess_utility(result: Anonymized, counters: dict | None = None) -> Utility:
    return utility_of(result.treatments, measure(result) if counters is None else counters)


def utility_of(treatments: list[Treatment], counters: dict) -> Utility:
    """Utility from counters by column."""
    cells = sum(c["cells"] for c in counters.values())
    removed = sum(c["removed"] for c in counters.values())
    rows, precision, types, distributions = [], [], [], []
    for t in treatments:
        if t.category == "Direct":
            rows.append((t.column, t.method, V.EXCLUDED_ROLE, None, None, None))
            continue
        figures = numeric_precision(t), type_kept(t), distribution_kept(t, counters.get(t.column, _NO_ROWS))
        for kept, figure in zip((precision, types, distributions), figures):
            if figure is not None:
                kept.append(figure)
        rows.append((t.column, t.method, V.ANALYTICAL_ROLE, *(None if f is None else round(f, 2) for f in figures)))
    factors = {
        "A": _mean([float(t.method != "Suppression") for t in treatments]),
        "B": 1 - removed / cells if cells else 1.0,
        "C": _mean(precision), "D": _mean(types), "E": _mean(distributions)}
    return Utility(factors, rows)


_NO_ROWS = {"numbers_after": 0, "numbers_before": 0, "spread_before": None}
