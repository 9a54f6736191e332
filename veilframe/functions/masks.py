"""Masks as column expressions."""

from pyspark.sql import Column, functions as F

from veilframe import fixed_values as V
from veilframe.functions.checks import compact_iban
from veilframe.functions.spans import PATTERNS, all_spans, may_hold_spans, resolve_overlaps
from veilframe.functions.text import ALNUM, SPACE, let, normalize_digits, strip

OWN_MASKS = {}          # entity to (column, strength) -> column, for registered entities
_A, _NOT_A = f"[{ALNUM}]", f"[^{ALNUM}]"


def _stars_between(c: Column, keep_start: int, keep_end: int) -> Column:
    # one pass: from the text start skip the kept characters, then star each
    # letter or number that still has enough of them after it
    skip = rf"(\G(?!^)|^(?:{_NOT_A}*+{_A}){{{keep_start}}})({_NOT_A}*+)"
    ahead = rf"(?=(?:{_NOT_A}*+{_A}){{{keep_end}}})" if keep_end else ""
    return F.regexp_replace(c, rf"{skip}{_A}{ahead}", "$1$2*")


def mask_alnum(c: Column, keep_start: int, keep_end: int) -> Column:
    """Star letters and numbers except the first and last few; separators stay.

    Values too short to hide at least two characters keep at most the first.
    """
    long_enough = c.rlike(rf"^(?:{_NOT_A}*+{_A}){{{keep_start + keep_end + 2}}}")
    return F.when(long_enough, _stars_between(c, keep_start, keep_end)).otherwise(
        _stars_between(c, min(keep_start, 1), 0))


def mask_generic(c: Column, strength: str) -> Column:
    return mask_alnum(c, *V.DEFAULT_KEEPS[strength])


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(normalize_digits(c), r"(?U)\D", "")


def mask_national_id(c: Column, strength: str) -> Column:
    return mask_alnum(_only_digits(c), *V.MASK_KEEPS["SAUDI_NATIONAL_ID"][strength])


def mask_mobile(c: Column, strength: str) -> Column:
    """Written in the local form (0 and the last nine digits) and then masked."""
    local = F.regexp_replace(_only_digits(c), r"(?U)^\d*(\d{9})\z", "0$1")
    return mask_alnum(local, *V.MASK_KEEPS["SAUDI_MOBILE"][strength])


def mask_iban(c: Column, strength: str) -> Column:
    return mask_alnum(compact_iban(normalize_digits(c)), *V.MASK_KEEPS["SAUDI_IBAN"][strength])


def mask_email(c: Column, strength: str) -> Column:
    """First character, stars, and either the domain or only its last label."""
    at = F.instr(c, "@")
    domain = F.substring(c, at + 1, F.length(c))
    last_label = F.substring_index(domain, ".", -1)
    hidden = F.when(F.contains(domain, F.lit(".")) & (last_label != ""), F.concat(F.lit("***."), last_label)
                    ).otherwise(F.lit("***"))
    first = F.substring(F.substring(c, F.lit(1), at - 1), 1, 1)
    masked = F.concat(first, F.lit("***@"), hidden if strength == "strong" else domain)
    return F.when(at > 0, masked).otherwise(mask_generic(c, strength))


def mask_person_name(c: Column) -> Column:
    """First letter of each word; words joined by one space."""
    words = F.regexp_replace(strip(c), rf"(?U)[{SPACE}]+", " ")
    return F.regexp_replace(words, r"(?<=[^ ])[^ ]", "*")


def mask_value(c: Column, entity: str | None, strength: str) -> Column:
    """Mask a whole value the way its entity asks for."""
    if entity in OWN_MASKS:
        return OWN_MASKS[entity](c, strength)
    if entity == "SAUDI_NATIONAL_ID":
        return mask_national_id(c, strength)
    if entity == "SAUDI_MOBILE":
        return mask_mobile(c, strength)
    if entity == "SAUDI_IBAN":
        return mask_iban(c, strength)
    if entity == "EMAIL_ADDRESS":
        return mask_email(c, strength)
    if entity in ("ARABIC_PERSON_NAME", "PERSON_NAME"):
        return mask_person_name(c)
    return mask_generic(c, strength)


def _mask_span(value: Column, entity: Column, strength: str) -> Column:
    masked = F.lit(None).cast("string")
    for name in PATTERNS:
        masked = F.when(entity == name, mask_value(value, name, strength)).otherwise(masked)
    return masked


def mask_free_text(c: Column, strength: str) -> Column:
    """Mask only the identifiers inside a text and leave the rest as it is."""
    # pieces are cut from an array of characters: a place in a text would be counted from its start each time
    def rewrite(parts):
        spans, chars = parts["spans"], parts["chars"]

        def piece(start, end):
            return F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")

        masked = F.transform(spans, lambda s, i: F.concat(
            piece(F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), s["start"]),
            let(piece(s["start"], s["end"]), lambda v: _mask_span(v, s["entity"], strength))))
        last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(masked, ""), piece(last, F.size(chars)))

    plain = normalize_digits(c)
    parts = F.struct(resolve_overlaps(let(plain, all_spans)).alias("spans"), F.split(c, "").alias("chars"))
    return F.when(may_hold_spans(plain), let(parts, rewrite)).otherwise(c)
