"""Sharing purposes and the treatment recommended for each entity."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe import fixed_values as V


@dataclass(frozen=True)
class Profile:
    key: str
    name: str
    strength: str               # of masks and dates: "strong" or "medium"
    target_bins: int            # bands a numeric range is cut into
    min_group_frac: float       # smallest share of rows a kept category has
    format_preserving: bool     # replacements look like the original
    description: str = ""


PROFILES = {p.key: p for p in (
    Profile("external", "AI / External Company", "strong", 3, 0.10, False,
            "For data that leaves the house: direct identifiers go or are hidden for the most part, indirect ones become wide bands."),
    Profile("developer", "Developer Testing", "medium", 8, 0.05, True,
            "For test systems: made-up identifiers of the same form, which programs and checks accept."),
    Profile("internal", "Internal Analytics", "medium", 12, 0.05, False,
            "For analysts of the house: narrow bands, pseudonyms that can be joined, and common categories as they are."),
)}

#: What each method does to a column, in the words of a plan.
REASONS = {
    "Keep": "low risk, and of use as it is",
    "Masking": "most characters are hidden, the form stays",
    "Suppression": "the value goes, which protects best",
    "Replacement": "a pseudonym or made-up value stands in its place",
    "Generalization": "exact values become bands or wider groups",
    "Hashing": "a salted one-way hash: rows can be joined, values not read",
}


def recommended_method(entity: str, profile: str) -> str:
    methods = dict(zip(PROFILES, V.RECOMMENDED.get(entity, ("Masking",) * len(PROFILES))))
    return methods[profile]


def policy(spark: SparkSession) -> DataFrame:
    """(entity, profile, recommended) for every entity and profile."""
    rows = [F.struct(F.lit(e).alias("entity"), F.lit(p).alias("profile"),
                     F.lit(recommended_method(e, p)).alias("recommended"))
            for e in V.RECOMMENDED for p in PROFILES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def profiles_table(spark: SparkSession) -> DataFrame:
    """The profiles and their settings."""
    rows = [F.struct(F.lit(p.key).alias("profile"), F.lit(p.name).alias("name"), F.lit(p.strength).alias("strength"),
                     F.lit(p.target_bins).alias("target_bins"), F.lit(p.min_group_frac).alias("min_group_frac"),
                     F.lit(p.format_preserving).alias("format_preserving"))
            for p in PROFILES.values()]
    return spark.range(1).select(F.inline(F.array(*rows)))
