"""Entities of one's own, found by pattern like the built-in ones."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from veilframe import fixed_values as V
from veilframe.functions import masks
from veilframe.functions.spans import PATTERNS, Pattern
from veilframe.operators import detect


_own: dict[str, tuple] = {}
_SCHEMA = ("entity string, pattern string, label string, category string, risk string, flags string, needle string, shortest int, weight double, check_weight double, "
           "column_keywords array<string>, context_keywords array<string>, recommended array<string>, direct_weight double, validated boolean, masked boolean")


def register_entity(entity: str, pattern: str, label: str, *, category: str = "Direct", risk: str = "HIGH", flags: str = "(?U)",
                    needle: str | None = None, shortest: int = 1, weight: float = 0.5, check_weight: float = 0.0,
                    validator: Callable[[Column], Column] | None = None, column_keywords: tuple[str, ...] = (),
                    context_keywords: tuple[str, ...] = (), recommended: tuple[str, str, str] = ("Suppression", "Replacement", "Masking"),
                    mask: Callable[[Column, str], Column] | None = None, direct_weight: float = V.DEFAULT_DIRECT_WEIGHT) -> None:
    """Make ``entity`` known to detection, corpus scans, masks, plans and risk in this process.

    ``pattern`` is a Java regular expression, ``needle`` a cheap one that every
    match holds, ``weight`` the confidence of a match and ``check_weight`` what a
    passed ``validator`` adds.  ``recommended`` are the methods for external,
    developer and internal sharing.  ``mask`` maps a column and a strength to the
    masked column.
    """
    if entity in V.ENTITIES:
        raise ValueError(f"{entity} is known already")
    _own[entity] = (entity, pattern, label, category, risk, flags, needle, shortest, weight, check_weight, list(column_keywords), list(context_keywords),
                    list(recommended), direct_weight, validator is not None, mask is not None)
    short = entity.lower()
    PATTERNS[entity] = Pattern(entity, flags, pattern, shortest, needle or flags + pattern, validator)
    V.PATTERN_WEIGHTS[entity] = (weight, check_weight, label)
    V.ENTITIES[entity] = (category, risk, label)
    V.COLUMN_KEYWORDS[entity] = list(column_keywords)
    V.CONTEXT_KEYWORDS[entity] = list(context_keywords)
    V.RECOMMENDED[entity] = recommended
    V.DIRECT_WEIGHTS[entity] = direct_weight
    detect.add_pattern(entity, short)
    if mask:
        masks.OWN_MASKS[entity] = mask


def forget_entity(entity: str) -> None:
    """Undo ``register_entity``."""
    for table in (PATTERNS, V.PATTERN_WEIGHTS, V.ENTITIES, V.COLUMN_KEYWORDS, V.CONTEXT_KEYWORDS, V.RECOMMENDED, V.DIRECT_WEIGHTS, masks.OWN_MASKS):
        table.pop(entity, None)
    detect.drop_pattern(entity)
    _own.pop(entity, None)


def entities_table(spark: SparkSession) -> DataFrame:
    """The registered entities, but for their functions."""
    return spark.createDataFrame(list(_own.values()), _SCHEMA)


def load_entities(spark: SparkSession, path: str, validators: dict[str, Callable[[Column], Column]] | None = None,
                  own_masks: dict[str, Callable[[Column, str], Column]] | None = None) -> list[str]:
    """Register the entities that a saved run knew and this process does not; returns their names.

    Functions are not saved: an entity that had a validator or a mask needs it again.
    """
    loaded = []
    for r in spark.read.parquet(f"{path}/entities").collect():          # as many rows as were registered
        if r["entity"] in V.ENTITIES:
            continue
        missing = [what for what, had, given in (("validator", r["validated"], validators), ("mask", r["masked"], own_masks)) if had and r["entity"] not in (given or {})]
        if missing:
            raise ValueError(f"{r['entity']} needs its {' and '.join(missing)}")
        register_entity(r["entity"], r["pattern"], r["label"], category=r["category"], risk=r["risk"], flags=r["flags"], needle=r["needle"], shortest=r["shortest"],
                        weight=r["weight"], check_weight=r["check_weight"], validator=(validators or {}).get(r["entity"]), column_keywords=tuple(r["column_keywords"]),
                        context_keywords=tuple(r["context_keywords"]), recommended=tuple(r["recommended"]), mask=(own_masks or {}).get(r["entity"]), direct_weight=r["direct_weight"])
        loaded.append(r["entity"])
    return loaded
