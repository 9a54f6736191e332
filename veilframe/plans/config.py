"""Per-column configuration: what was found, the category, and the treatment."""

from pyspark.sql import DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.operators.corpus import base_risk_of
from veilframe.plans.profiles import REASONS, policy


def _ordered_entities(found: DataFrame, *sort_keys) -> DataFrame:
    # at most four pattern entities and one other per column
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys)], F.col("place"), F.col("entity"),
                     F.col("category"))
    return found.groupBy("column").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("confidence").alias("confidence"),
        F.bool_or("embedded").alias("embedded"))


def _direct_first():
    return F.when(F.col("category") == "Direct", 0).otherwise(1)


def column_entities(detections: DataFrame) -> DataFrame:
    """(column, entities, embedded): direct first, then by confidence."""
    found = _ordered_entities(detections.where("flagged"), _direct_first(), -F.col("confidence"))
    return found.select("column", F.col("entries.entity").alias("entities"), "embedded")


def columns_table(df_columns: list[str], spark) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(df_columns)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def build_config(detections: DataFrame, columns: list[str], profile: str) -> DataFrame:
    """One row per column with the recommended treatment for a sharing purpose.

    Entities are ordered direct first, then high base risk, then confidence; the
    first decides.  Columns with an identifier inside free text are masked.
    """
    spark = detections.sparkSession
    not_high = F.when(base_risk_of(F.col("entity")) == "HIGH", 0).otherwise(1)
    found = _ordered_entities(detections.where("flagged"), _direct_first(), not_high, -F.col("confidence"))
    first = found.select(
        "column", "confidence", "embedded", F.array_join("entries.entity", ", ").alias("detected"),
        F.get("entries", F.lit(0))["entity"].alias("entity"), F.get("entries", F.lit(0))["category"].alias("category"))
    rules = policy(spark).where(F.col("profile") == profile).drop("profile")
    # both sides have as many rows as the header or the fixed entity list
    planned = (columns_table(columns, spark).join(F.broadcast(first), "column", "left")
               .join(F.broadcast(rules), "entity", "left"))
    method = (F.when(F.col("entity").isNull(), "Keep").when(F.col("embedded"), "Masking")
              .otherwise(F.coalesce("recommended", F.lit("Masking"))))
    return planned.select(
        "position", "column", F.coalesce("detected", F.lit(V.NOTHING_DETECTED)).alias("detected"), "confidence",
        F.coalesce("category", F.lit("Non-sensitive")).alias("category"),
        method.alias("recommended"), method.alias("method"))


def override_config(config: DataFrame, methods: dict[str, str] | None = None,
                    categories: dict[str, str] | None = None) -> DataFrame:
    """Replace the method or the category of some columns."""
    for given, allowed in ((methods, V.METHODS), (categories, V.CATEGORIES)):
        unknown = set((given or {}).values()) - set(allowed)
        if unknown:
            raise ValueError(f"not one of {allowed}: {sorted(unknown)}")
    for target, given in (("method", methods), ("category", categories)):
        changed = F.col(target)
        for column, value in (given or {}).items():
            changed = F.when(F.col("column") == column, value).otherwise(changed)
        config = config.withColumn(target, changed)
    return config


def explain_config(config: DataFrame) -> DataFrame:
    """The configuration with ``reason``, what the method of each column is for."""
    reason = F.lit(None).cast("string")
    for method, text in REASONS.items():
        reason = F.when(F.col("method") == method, text).otherwise(reason)
    return config.withColumn("reason", reason)


def kept_direct(config: DataFrame) -> DataFrame:
    """Direct identifiers left unchanged."""
    return config.where((F.col("category") == "Direct") & (F.col("method") == "Keep"))
