"""One table under every purpose, from one projection.

Purposes often treat a column alike.  Each different treatment of a column is
computed once, in one read of the table that compares it with the original and
stores codes of what the classes of indirect identifiers need; every purpose is
then scored from these.  No treated table is written, and no original.
"""

import secrets

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.fakes import STATELESS_FAKES
from veilframe.functions.text import named
from veilframe.operators.counters import Counters
from veilframe.operators.risk import QuasiRisk, Risk, code, quasi_risk, risk_of
from veilframe.operators.utility import Utility, utility_of
from veilframe.plans.anonymize import Treatment, as_text, decide_generalisations, resolve_treatments, treated_column
from veilframe.plans.config import build_config
from veilframe.plans.profiles import PROFILES, Profile
from veilframe.session import stage


def signature(t: Treatment, profile: Profile) -> tuple:
    """All that the treated values of a column depend on: equal signatures give equal values."""
    how: tuple = ()
    if t.method == "Masking":
        how = (t.embedded, None if t.embedded else t.entity, profile.strength)
    elif t.method == "Generalization":
        how = (t.rule, t.width, tuple(t.kept), profile.strength == "strong" if t.rule == "date" else None)
    elif t.method == "Replacement":
        how = (t.entity, profile.format_preserving)
    return (t.column, t.method, *how)


def _renames(t: Treatment, profile: Profile) -> bool:
    """Whether values only get other names, so that nothing is removed and classes, where they count, stay what they were."""
    if t.method == "Replacement":       # made-up names may be fewer than originals
        return t.category != "Indirect" or not (profile.format_preserving and t.entity in STATELESS_FAKES)
    return t.method in ("Keep", "Hashing")


def score_profiles(df: DataFrame, detections: DataFrame, columns: list[str], row_key: str, salt: str | None = None) -> dict[str, tuple[Risk, Utility]]:
    """Risk and utility of ``df`` under every purpose, as ``anonymize`` would treat it."""
    salt, key = salt if salt is not None else secrets.token_hex(8), secrets.token_hex(16)
    plans = {p: resolve_treatments(build_config(detections, columns, p), detections) for p in PROFILES}
    text = as_text(df, plans[next(iter(plans))], row_key)
    decide_generalisations(text, [(treatments, PROFILES[p]) for p, treatments in plans.items()])
    chosen = {signature(t, PROFILES[p]): (t, PROFILES[p]) for p, treatments in plans.items() for t in treatments}
    place = {s: i for i, s in enumerate(chosen)}
    computed = {s: (t, p) for s, (t, p) in chosen.items() if not _renames(t, p)}
    kept = {s for s, (t, _) in chosen.items() if t.method == "Keep"}
    projected = text.select(*[named(c) for c in columns], *[treated_column(t, p, salt, False, 0).alias(_after(place[s])) for s, (t, p) in computed.items()])

    counters = Counters({str(place[s]): (t.column, t.column if s in kept else _after(place[s]), t.measure)
                         for s, (t, p) in chosen.items() if s in kept or s in computed})
    coded: dict[str, Column] = {}
    for s, (t, p) in chosen.items():
        if t.category == "Indirect" or t.counts_values:
            coded[_before(columns, t)] = code(named(t.column), key)
            if s in computed:
                coded[_after(place[s])] = code(F.col(_after(place[s])), key)
    codes = stage(counters.watch(projected).select(F.lit(0).alias("none"), *[c.alias(name) for name, c in coded.items()]), "codes")
    found = counters.read()

    counted = sorted({x for s, (t, _) in computed.items() if t.counts_values for x in (_before(columns, t), _after(place[s]))})
    distinct = _distinct(codes, counted)
    null = F.xxhash64(F.lit(key), F.lit(V.NULL_CLASS))
    classes_of: dict[tuple, QuasiRisk] = {}

    def quasi(names: list[str]) -> QuasiRisk:
        if tuple(names) not in classes_of:
            classes_of[tuple(names)] = quasi_risk(codes.select(*[F.coalesce(F.col(x), null).alias(x) for x in names]), names)
        return classes_of[tuple(names)]

    out = {}
    for p, treatments in plans.items():
        of: dict[str, dict] = {}
        before, after = [], []
        for t in treatments:
            s = signature(t, PROFILES[p])
            if found:
                rows = next(iter(found.values()))["cells"]
                of[t.column] = {"cells": rows, "removed": 0} | found.get(str(place[s]), {})
                if t.counts_values:
                    of[t.column] |= {"distinct_before": distinct.get(_before(columns, t), 0), "distinct_after": distinct.get(_after(place[s]), 0)}
            if t.category == "Indirect":
                before.append(_before(columns, t))
                after.append(_after(place[s]) if s in computed else _before(columns, t))
        out[p] = risk_of(treatments, of, quasi(before), quasi(after)), utility_of(treatments, of)
    return out


def _before(columns: list[str], t: Treatment) -> str:
    return f"__before_{columns.index(t.column)}"


def _after(i: int) -> str:
    return f"__after_{i}"


def _distinct(codes: DataFrame, names: list[str]) -> dict[str, int]:
    if not names:
        return {}
    cells = codes.unpivot([], names, "name", "code").where("code is not null")
    counts = cells.groupBy("name", "code").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("n"))
    return {r["name"]: r["n"] for r in counts.collect()}
