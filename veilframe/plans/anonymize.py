"""Apply a configuration to a table: statistics first, then one projection."""

import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from veilframe import fixed_values as V
from veilframe.functions.text import named
from veilframe.operators import lookup, treat
from veilframe.operators.book import PseudonymBook
from veilframe.operators.counters import NUMBERS, SPANS, VISIBLE, Counters
from veilframe.plans.config import column_entities
from veilframe.plans.profiles import PROFILES, Profile
from veilframe.session import drop_staged, stage, staged_inside

BEFORE = "__before"


@dataclass
class Treatment:
    """What is done to one column; everything here is decided before the projection."""
    column: str
    method: str
    category: str
    entities: list[str] = field(default_factory=list)
    embedded: bool = False
    kind: str = "text"
    rule: str = ""                  # how a generalised column is generalised
    width: float | None = None
    kept: list[str] = field(default_factory=list)
    low: float | None = None
    high: float | None = None

    @property
    def entity(self) -> str | None:
        return self.entities[0] if self.entities else None

    @property
    def measure(self) -> str | None:
        """What scores need to know of the column beside what they need of all."""
        if self.method == "Masking":
            return SPANS if self.embedded else VISIBLE
        return NUMBERS if self.method == "Generalization" and self.kind == "numeric" and self.category != "Direct" else None

    @property
    def counts_values(self) -> bool:
        """Whether scores need the numbers of distinct values before and after."""
        return self.method == "Generalization" and self.kind != "numeric" and self.category != "Direct"


@dataclass
class Anonymized:
    """The treated table, and counters of what became of each column.

    ``source`` is the table as it came, as text; it is read again where originals are
    asked for and never stored.
    """
    data: DataFrame
    treatments: list[Treatment]
    profile: Profile
    row_key: str
    source: DataFrame
    counters: dict[str, dict] | None = None
    projected: DataFrame | None = None      # of a result that is not staged: treated and original columns

    @property
    def columns(self) -> list[str]:
        return [t.column for t in self.treatments]

    @property
    def paired(self) -> DataFrame:
        """Treated columns, and as they were under ``<column>__before``, for looking into single rows; brought together by row key."""
        if self.projected is not None:
            return self.projected
        before = self.source.select(named(self.row_key).alias("__key"), *[named(c).alias(c + BEFORE) for c in self.columns])
        return self.data.join(before, named(self.row_key).eqNullSafe(F.col("__key"))).drop("__key")


def resolve_treatments(config: DataFrame, detections: DataFrame) -> list[Treatment]:
    """Configuration and detected entities as plan data: one entry per column of the header."""
    joined = config.join(F.broadcast(column_entities(detections)), "column", "left").orderBy("position")
    return [Treatment(r["column"], r["method"], r["category"], list(r["entities"] or []), bool(r["embedded"]))
            for r in joined.collect()]


def _generalisation_rule(t: Treatment, figures) -> str:
    if t.kind == "numeric":
        return "numeric"
    if t.kind == "date" or t.entity == "DATE_OF_BIRTH":
        return "date"
    if t.entity == "SAUDI_ADDRESS":
        return "address"
    if t.entity == "CITY" and figures["regions"] >= V.REGION_SHARE * figures["present"]:
        return "region"
    return "merge"


def figures_by_column(df: DataFrame, columns: list[str]) -> dict:
    """Kind, range and band widths under every purpose: one pass, one row per column."""
    if not columns:
        return {}
    bins = {p.key: p.target_bins for p in PROFILES.values()}
    figures = treat.band_widths(treat.column_kinds(treat.column_figures(df, columns)), bins)
    return {r["column"]: r for r in figures.collect()}


def decide_generalisations(df: DataFrame, plans: list[tuple[list[Treatment], Profile]]) -> None:
    """Fill in kinds, ranges, widths and kept categories of all plans, from two passes over the columns concerned."""
    # figures are needed for what is generalised, and kinds for whatever is scored
    wanted = [(t, profile) for treatments, profile in plans for t in treatments if t.method == "Generalization" or t.category != "Direct"]
    figures = figures_by_column(df, sorted({t.column for t, _ in wanted}))
    merged = []
    for t, profile in wanted:
        row = figures.get(t.column)
        if row is None:             # no rows at all
            t.rule = "merge" if t.method == "Generalization" else ""
            continue
        t.kind, t.low, t.high = row["kind"], row["low"], row["high"]
        if t.method == "Generalization":
            t.rule = _generalisation_rule(t, row)
            t.width = row[f"width_{profile.key}"] if t.rule == "numeric" else None
            if t.rule == "merge":
                merged.append((t, profile, row["present"]))
    if merged:
        present = {t.column: n for t, _, n in merged}
        common = treat.common_categories(df, present, min(p.min_group_frac for _, p, _ in merged)).collect()
        for t, profile, n in merged:
            enough = treat.enough_rows(n, profile.min_group_frac)
            t.kept = sorted(r["value"] for r in common if r["column"] == t.column and r["n_rows"] >= enough)


def numbered_columns(treatments: list[Treatment], profile: Profile) -> list[str]:
    """Columns whose replacements are numbered."""
    return [t.column for t in treatments if t.method == "Replacement"
            and treat.needs_numbers(t.entity, profile.format_preserving)]


def treated_column(t: Treatment, profile: Profile, salt: str, strict: bool, hash_length: int) -> Column:
    c = named(t.column)
    if t.method == "Masking":
        if strict and t.embedded:
            return treat.suppress(c)
        return treat.mask(c, t.entity, t.embedded, "strong" if strict else profile.strength)
    if t.method == "Suppression":
        return treat.suppress(c)
    if t.method == "Hashing":
        return treat.hash_value(c, salt, hash_length)
    if t.method == "Replacement":
        if treat.needs_numbers(t.entity, profile.format_preserving):
            return treat.replace_numbered(c, named(f"__number_{t.column}"), t.entity, profile.format_preserving)
        return treat.replace_stateless(c, t.entity, salt)
    if t.method == "Generalization":
        return {
            "numeric": lambda: treat.generalize_numeric(c, F.lit(t.width), strict),
            "date": lambda: treat.generalize_date(c, profile.strength == "strong", strict),
            "address": lambda: treat.generalize_address(c),
            "region": lambda: treat.city_region(c),
            "merge": lambda: treat.merge_rare(c, t.kept),
        }[t.rule]()
    return c


def apply_treatments(df: DataFrame, treatments: list[Treatment], profile: Profile, salt: str, row_key: str,
                     strict: bool = False, hash_length: int = treat.HASH_LENGTH, numbers: DataFrame | None = None,
                     broadcast_bytes: int = lookup.BROADCAST_BYTES, book: PseudonymBook | None = None) -> DataFrame:
    """One projection that yields every column treated, and as it was under ``<column>__before``.

    Numbered replacements count the values of ``df``, or have their numbers in ``book``.
    """
    numbered = numbered_columns(treatments, profile)
    if numbered and book:
        df = book.attach(df, row_key, numbered, broadcast_bytes)
    elif numbered:
        if numbers is None:
            numbers = stage(lookup.first_seen_numbers(df, row_key, numbered), "numbers")
        df = lookup.attach_numbers(df, row_key, numbered, numbers, broadcast_bytes)
    return df.select(
        named(row_key), *[treated_column(t, profile, salt, strict, hash_length).alias(t.column) for t in treatments],
        *[named(t.column).alias(t.column + BEFORE) for t in treatments])


def as_text(df: DataFrame, treatments: list[Treatment], row_key: str) -> DataFrame:
    return df.select(named(row_key), *[named(t.column).cast("string").alias(t.column) for t in treatments])


def anonymize(df: DataFrame, config: DataFrame, detections: DataFrame, profile: str, row_key: str,
              salt: str | None = None, strict: bool = False, hash_length: int = treat.HASH_LENGTH, staged: bool = True,
              book: PseudonymBook | None = None) -> Anonymized:
    """Treat a table the way ``config`` says.

    ``row_key`` is unique and gives the order in which values count as first
    seen.  ``salt`` keys hashes and fakes; by default a new one is drawn, so outputs of
    two runs cannot be linked.  ``hash_length`` hexadecimal characters are kept of
    a hash; with the default no two values share a pseudonym at any size, ten make a short one.  ``strict`` also removes values that a
    generalisation would leave as they are, hides the domains of e-mails, and suppresses free text
    instead of masking the identifiers inside it.  The treated table is written to the work
    folder; what scores need to know of originals is counted during that write, and they
    are not stored.  ``staged=False`` leaves the result lazy.  The map from values to
    pseudonyms is deleted once the result is written.  With a ``book``, numbered
    replacements go on from the tables and streams that it was used for before.
    """
    spark, chosen = df.sparkSession, PROFILES[profile]
    salt = salt if salt is not None else secrets.token_hex(8)
    treatments = resolve_treatments(config, detections)
    text = as_text(df, treatments, row_key)
    decide_generalisations(text, [(treatments, chosen)])
    shown = [named(row_key), *[named(t.column) for t in treatments]]
    numbered = numbered_columns(treatments, chosen)
    if book and numbered:
        book.extend(text, row_key, numbered)
    with staged_inside() as maps:
        paired = apply_treatments(text, treatments, chosen, salt, row_key, strict, hash_length, book=book)
    if not staged:
        return Anonymized(paired.select(*shown), treatments, chosen, row_key, text, projected=paired)
    counters = Counters({t.column: (t.column + BEFORE, t.column, t.measure) for t in treatments})
    try:
        data = stage(counters.watch(paired).select(*shown), "treated")
        return Anonymized(data, treatments, chosen, row_key, text, counters.read())
    finally:
        drop_staged(spark, maps)        # from values to pseudonyms: nothing that undoes the treatment stays
