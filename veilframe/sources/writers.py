"""Results as files."""

from pyspark.sql import DataFrame, SparkSession

from veilframe.plans.anonymize import Anonymized, Treatment
from veilframe.plans.entities import entities_table


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 with a header in each part file; null cells are empty and white space stays."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def save_run(path: str, detections: DataFrame, config: DataFrame, result: Anonymized, risk, utility,
             mode: str = "errorifexists") -> None:
    """Detections, configuration, treated data, scores and entities of one's own as Parquet under one folder."""
    spark = result.data.sparkSession
    tables = {"detections": detections, "config": config, "data": result.data,
              "treatments": treatments_table(spark, result), "entities": entities_table(spark), "risk": risk.table(spark), "utility": utility.table(spark)}
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables ``save_run`` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("detections", "config", "treatments", "data", "risk", "utility")}


def treatments_table(spark: SparkSession, result: Anonymized) -> DataFrame:
    """What was decided for each column, with the purpose: enough to treat later rows the same way."""
    rows = [(i, result.profile.key, t.column, t.method, t.category, t.entities, t.embedded, t.kind, t.rule, t.width, t.kept, t.low, t.high)
            for i, t in enumerate(result.treatments)]
    return spark.createDataFrame(rows, "position int, profile string, column string, method string, category string, entities array<string>, "
                                 "embedded boolean, kind string, rule string, width double, kept array<string>, low double, high double")


def load_treatments(spark: SparkSession, path: str) -> tuple[str, list[Treatment]]:
    """The purpose and the treatments that ``save_run`` wrote, for ``apply_treatments`` or ``treated_stream``."""
    rows = spark.read.parquet(f"{path}/treatments").orderBy("position").collect()       # one row per column
    fields = ("column", "method", "category", "entities", "embedded", "kind", "rule", "width", "kept", "low", "high")
    return (rows[0]["profile"] if rows else ""), [Treatment(**{f: r[f] for f in fields}) for r in rows]
