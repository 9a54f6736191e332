"""Scan a text column: one row per identifier found, or the text with identifiers masked."""

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.masks import mask_free_text
from veilframe.functions.numbers import round_exact
from veilframe.functions.spans import PATTERNS, find_spans, span_context, span_valid
from veilframe.functions.text import look_up_literal, named, normalize_digits, strings


def lower_risk(base: Column, confidence: Column) -> Column:
    """Base risk, one step lower when the confidence is low."""
    lowered = F.when(base == "HIGH", "MEDIUM").otherwise("LOW")
    return F.when(confidence < V.LOWER_RISK_BELOW, lowered).otherwise(base)


def by_entity(entity: Column, values: dict) -> Column:
    """Value of a small fixed table looked up by entity."""
    return look_up_literal(values, entity)


def category_of(entity: Column) -> Column:
    return by_entity(entity, {e: c for e, (c, _, _) in V.ENTITIES.items()})


def base_risk_of(entity: Column) -> Column:
    return by_entity(entity, {e: r for e, (_, r, _) in V.ENTITIES.items()})


def label_of(entity: Column) -> Column:
    return by_entity(entity, {e: label for e, (_, _, label) in V.ENTITIES.items()})


def text_spans(df: DataFrame, key: str, text: str, entities: list[str] | None = None) -> DataFrame:
    """One row per span: the key, offsets, entity, matched fragment, and the normalised text."""
    plain = df.select(named(key), named(text).alias("text"), normalize_digits(named(text)).alias("plain"))
    found = F.concat(*[find_spans(F.col("plain"), e) for e in entities or PATTERNS])
    # explode_outer: the plain explode would add a size filter that evaluates the spans twice
    spans = plain.select(named(key), "text", "plain", F.explode_outer(found).alias("span"))
    return spans.where("span.start is not null").select(
        named(key), "text", "plain", "span.start", "span.end", "span.entity", "span.frag")


def _by_pattern(entity: Column, value) -> Column:
    result = F.lit(None)
    for name in PATTERNS:
        result = F.when(entity == name, value(name)).otherwise(result)
    return result


def corpus_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every identifier in every text with its confidence, risk and reasons."""
    entity, start, end = F.col("entity"), F.col("start"), F.col("end")
    spans = text_spans(df, key, text)
    place = _by_pattern(entity, lambda e: span_context(F.col("plain"), F.struct(start, end), e))
    checked = spans.select(
        named(key), "start", "end", "entity", F.substring(F.col("text"), start + 1, end - start).alias("found"),
        _by_pattern(entity, lambda e: span_valid(F.col("frag"), e)).alias("valid"), place.alias("place"))

    weight = by_entity(entity, {e: p.weights[0] for e, p in PATTERNS.items()})
    check_weight = by_entity(entity, {e: p.weights[1] for e, p in PATTERNS.items()})
    label = by_entity(entity, {e: p.weights[2] for e, p in PATTERNS.items()})
    keyword = _by_pattern(entity, lambda e: F.try_element_at(strings(V.CONTEXT_KEYWORDS[e]), F.col("place").cast("int")))
    has_check = entity.isin([e for e, p in PATTERNS.items() if p.validator])
    raw = (weight + F.when(has_check & F.col("valid"), check_weight).otherwise(0.0)
           + F.when(F.col("place").isNotNull(), V.CONTEXT_WEIGHT).otherwise(0.0)
           + V.WHOLE_CELL_BONUS)
    said = V.TEXT_REASONS
    before, after = said["pattern"].split("{label}")
    before_word, after_word = said["context"].split("{keyword}")
    reasons = F.array_compact(F.array(
        F.concat(F.lit(before), label, F.lit(after)),
        F.when(has_check, F.when(F.col("valid"), said["checksum"]).otherwise(said["no_checksum"])),
        F.when(F.col("place").isNotNull(), F.concat(F.lit(before_word), keyword, F.lit(after_word)))
        .otherwise(said["no_context"])))
    scored = checked.withColumn("confidence", round_exact(F.least(raw, F.lit(V.CONFIDENCE_CAP)), 2))
    return scored.select(
        named(key), "start", "end", "found", "entity", "confidence",
        F.when(F.col("confidence") >= V.FLAG_AT, lower_risk(base_risk_of(entity), F.col("confidence")))
        .otherwise(V.NOT_FLAGGED).alias("risk"),
        F.array_join(reasons, " + ").alias("reason"))


def mask_text(df: DataFrame, text: str, strength: str = "medium") -> DataFrame:
    """``df`` with the identifiers inside one text column masked; works on streams too."""
    return df.withColumn(text, mask_free_text(named(text), strength))
