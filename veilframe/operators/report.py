"""Recommendations, verdict, report lines, and the comparison of purposes."""

from datetime import datetime

from pyspark.sql import DataFrame

from veilframe import fixed_values as V
from veilframe.operators.compare import score_profiles
from veilframe.operators.detect import flagged
from veilframe.operators.risk import Risk, level
from veilframe.operators.utility import Utility
from veilframe.plans.anonymize import Anonymized


def recommendations(result: Anonymized, risk: Risk, utility: Utility) -> list[str]:
    """What to do next, most urgent first."""
    say = V.ADVICE
    kept = ", ".join(t.column for t in result.treatments if t.category == "Direct" and t.method == "Keep")
    k = risk.quasi_after.k
    otherwise = "." if result.profile.key == "external" else say["unique_elsewhere"]
    by_level = {"HIGH": say["high"], "MEDIUM": say["medium"]}
    advice = [
        *(say["exposed"].format(column=c, method=m) for c, m in risk.remaining),
        say["kept"].format(columns=kept) if kept else None,
        say["unique"].format(otherwise=otherwise) if k is not None and k < V.SMALLEST_SAFE_CLASS else None,
        by_level.get(level(round(risk.after))),
        say["useless"] if round(utility.score) < V.USEFUL_FROM else None,
        say["free_text"], say["review"]]
    return [line for line in advice if line]


def verdict(risk: Risk, utility: Utility) -> str:
    before, after, useful = round(risk.before), round(risk.after), round(utility.score)
    if before - after >= V.BIG_DROP and useful >= V.USEFUL_FROM:
        kind = "much"
    else:
        kind = "some" if before > after else "none"
    return V.VERDICTS[kind].format(before=before, after=after, useful=useful, level=level(risk.after))


def _table(header: list[str], rows: list[tuple]) -> list[str]:
    return [f"| {' | '.join(header)} |", "|" + "---|" * len(header),
            *[f"| {' | '.join(map(str, r))} |" for r in rows]]


def privacy_report(result: Anonymized, detections: DataFrame, risk: Risk, utility: Utility, name: str,
                   records: int, when: datetime | None = None) -> DataFrame:
    """The report as lines (section, line_no, text); write it with ``write.text``."""
    spark = result.data.sparkSession
    # a handful of rows per column of the header
    found = [r.asDict() for r in flagged(detections).orderBy("category", "column", "position", "place").collect()]
    line = {k: v.format for k, v in V.REPORT_LINES.items()}

    def columns_of(category: str) -> str:
        return ", ".join(sorted({f["column"] for f in found if f["category"] == category})) or "none"
    findings = [(f["column"], f["label"], f["category"], f"{f['confidence']:.0%}", f["risk"], "; ".join(f["reasons"]))
                for f in found]
    changed = [(t.column, t.category, t.method) for t in result.treatments if t.method != "Keep"]
    bodies = [
        [line["dataset"](name=name), line["date"](when=when or datetime.now()),
         line["size"](records=records, columns=len(result.columns)), line["purpose"](profile=result.profile.name)],
        [line["fields"](fields=len({f["column"] for f in found})),
         line["types"](labels=", ".join(sorted({f["label"] for f in found})) or "none"),
         *_table(V.REPORT_TABLES["findings"], findings)],
        _table(V.REPORT_TABLES["methods"], changed or [V.NO_CHANGES]),
        [line["direct"](columns=columns_of("Direct")),
         line["exposed"](columns=", ".join(c for c, _ in risk.remaining) or "none"),
         line["indirect"](columns=columns_of("Indirect"))],
        [line["before"](score=round(risk.before), level=level(risk.before)),
         line["after"](score=round(risk.after), level=level(risk.after)), *[f"- {r}" for r in risk.reasons()]],
        [line["utility"](score=round(utility.score)),
         *_table(V.REPORT_TABLES["factors"], utility.factor_rows())],
        [f"- {r}" for r in recommendations(result, risk, utility)],
        [line["detection"](), line["scores"](), line["disclaimer"]()]]
    lines = []
    for number, (title, body) in enumerate(zip(V.REPORT_TITLES, bodies)):
        for text in [f"{'#' if number == 0 else '##'} {title}", "", *body, ""]:
            lines.append((number, len(lines), text))
    return spark.createDataFrame(lines, "section int, line_no int, text string")


def compare_profiles(df: DataFrame, detections: DataFrame, columns: list[str], row_key: str,
                     salt: str | None = None) -> DataFrame:
    """Risk and utility of the same table under every purpose."""
    rows = [(p, risk.before, risk.after, utility.score, risk.quasi_after.k, level(risk.before), level(risk.after), verdict(risk, utility))
            for p, (risk, utility) in score_profiles(df, detections, columns, row_key, salt).items()]
    return df.sparkSession.createDataFrame(
        rows, "profile string, risk_before double, risk_after double, utility double, k_after bigint, "
              "level_before string, level_after string, verdict string")
