"""Number parsing, bands and rounding as column expressions."""

from pyspark.sql import Column, functions as F

from veilframe import fixed_values as V
from veilframe.functions.text import ascii_digits, let, strip

# digits may be grouped by single underscores; NaN and infinities are not numbers here
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_SIGNED = r"-?[0-9]+(?:\.[0-9]+)?"
_BAND = rf"(?U)^\s*({_SIGNED})\s*[–-]\s*({_SIGNED})\s*\z"


def _without_commas(c: Column) -> Column:
    return strip(F.regexp_replace(ascii_digits(c), ",", ""))


def _number_of(plain: Column) -> Column:
    value = F.regexp_replace(plain, "_", "").try_cast("double")
    # a number too large for a double reads as infinity, which no band can hold
    return F.when(plain.rlike(_NUMBER) & (F.abs(value) < float("inf")), value)


def parse_number(c: Column) -> Column:
    """Text as double (commas dropped, any decimal digits), or null."""
    return let(_without_commas(c), _number_of)


def band_midpoint(c: Column) -> Column:
    """Middle of a ``lo–hi`` band, else the number itself, else null."""
    def middle(plain):
        low, high = (F.regexp_extract(plain, _BAND, g).try_cast("double") for g in (1, 2))
        return F.when(plain.rlike(_BAND), (low + high) / 2).otherwise(_number_of(plain))
    return let(_without_commas(c), middle)


def looks_like_date(c: Column) -> Column:
    """Starts like ``1-4 digits, separator, 1-2 digits, separator, 1-4 digits``."""
    return c.rlike(r"(?U)^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")


def band_label(value: Column, width: Column) -> Column:
    """``lo–hi`` band of ``width`` that holds ``value``."""
    low = F.floor(value / width) * width
    return F.concat(F.format_number(low, 0), F.lit("–"), F.format_number(low + width, 0))


def nearest_width(low: Column, high: Column, target_bins: Column | int) -> Column:
    """The listed band width closest, on a log scale, to the range cut in ``target_bins``."""
    spread = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    raw = spread / target_bins
    ranked = F.array(*[
        F.struct(F.abs(F.log(F.lit(float(w)) / raw)).alias("distance"), F.lit(i).alias("place"),
                 F.lit(float(w)).alias("width"))
        for i, w in enumerate(V.BAND_WIDTHS)])
    return F.when(raw.isNotNull(), F.array_min(ranked)["width"])


def round_exact(c: Column, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    The built-in rounds the shortest decimal text of the double, so 0.175 (in
    binary a little less) goes up.  Here the rounding error of ``c * 10**digits``
    is computed exactly (by splitting the factor) and decides what looks like a tie.
    """
    scale = float(10 ** digits)
    product = c * scale
    split = c * 134217729.0
    high = split - (split - c)
    error = (high * scale - product) + (c - high) * scale
    below = F.floor(product).cast("double")
    tie = (product - below) == 0.5
    rounded = (F.when(tie & (error > 0), below + 1)
               .when(tie & (error < 0), below)
               .otherwise(F.rint(product)))
    return rounded / scale
