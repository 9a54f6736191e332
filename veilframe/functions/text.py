"""Text normalisation and lexicon tests as column expressions.

The regular expressions spell out character classes (letters, numbers, white
space) instead of relying on ``\\w``/``\\s``, whose meaning depends on flags.
"""

import re
import unicodedata

from pyspark.sql import Column, functions as F

from veilframe import fixed_values as V

WORD = r"\p{L}\p{N}_"
ALNUM = r"\p{L}\p{N}"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
SPACE = r"\s\x1c-\x1f"          # used under (?U); the separators 1c-1f count as white space
NOT_IN_WORD_BEFORE = rf"(?<![{WORD}])"

_WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_OTHER_DIGITS = "".join(
    c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
_OTHER_DIGITS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters a header has."""
    return F.col("`" + column.replace("`", "``") + "`")


def _unless_ascii(c: Column, rewritten: Column, ascii_form: Column) -> Column:
    # ASCII text has as many bytes as characters; per-character rewriting is skipped for it
    return F.when(F.octet_length(c) == F.length(c), ascii_form).otherwise(rewritten)


def normalize_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits as ASCII digits; the length does not change."""
    return _unless_ascii(c, F.translate(c, V.ARABIC_DIGITS, V.ASCII_DIGITS), c)


def ascii_digits(c: Column) -> Column:
    """Every Unicode decimal digit as an ASCII digit."""
    return _unless_ascii(c, F.translate(c, _OTHER_DIGITS, _OTHER_DIGITS_ASCII), c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove any Unicode white space at both ends."""
    return F.btrim(c, F.lit(_WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for text of white space only; null stays null."""
    return strip(c) == ""


def fold_arabic(c: Column) -> Column:
    """Drop marks and tatweel, unify alef/yaa/taa-marbuta, strip, lower-case."""
    folded = F.translate(c, V.ARABIC_LETTERS + V.ARABIC_MARKS, V.ARABIC_FOLDED)
    return F.lower(strip(_unless_ascii(c, folded, c)))


def fold_arabic_literal(s: str) -> str:
    """``fold_arabic`` for a plan-time constant such as a keyword or a column name."""
    table = str.maketrans(V.ARABIC_LETTERS, V.ARABIC_FOLDED, V.ARABIC_MARKS)
    return s.translate(table).strip().lower()


def name_tokens(c: Column) -> Column:
    """Folded words; punctuation and underscores separate."""
    return F.filter(F.split(fold_arabic(c), rf"[^{ALNUM}]+"), lambda t: t != "")


def literal_tokens(s: str) -> list[str]:
    """``name_tokens`` for a plan-time constant."""
    return re.findall(r"[^\W_]+", fold_arabic_literal(s))


# --------------------------------------------------------------------------- names
_LEXICON = sorted({fold_arabic_literal(w) for w in (
    V.AR_FIRST_NAMES + V.AR_FAMILY_NAMES + V.EN_FIRST_NAMES + V.EN_FAMILY_NAMES + V.NAME_PARTICLES)})
_ARTICLE = "ال"
_FAMILIES_BARE = sorted({fold_arabic_literal(w).removeprefix(_ARTICLE) for w in V.AR_FAMILY_NAMES})
_GAP = rf"{SPACE}\-"
_NAME_SHAPE = rf"(?U)^[{_GAP}]*+{LETTER}++(?:[{_GAP}]++{LETTER}++){{1,4}}[{_GAP}]*+\z"


def has_name_shape(c: Column) -> Column:
    """Two to five words of letters only, separated by white space or hyphens."""
    return c.rlike(_NAME_SHAPE)


def folded_in_name_lexicon(folded: Column) -> Column:
    """``in_name_lexicon`` for text that is folded already."""
    return F.exists(F.split(folded, rf"(?U)[{_GAP}]+"), lambda w: w.isin(_LEXICON)
                    | F.regexp_replace(w, f"^{_ARTICLE}", "").isin(_FAMILIES_BARE))


def in_name_lexicon(c: Column) -> Column:
    """A word is a known first name, family name (with or without article) or particle."""
    return folded_in_name_lexicon(fold_arabic(c))


def has_arabic(c: Column) -> Column:
    return c.rlike(f"[{V.ARABIC_BLOCK}]")


def name_shape(c: Column, folded: Column | None = None) -> Column:
    """Struct of (shape_ok, lexicon_hit, is_arabic); the last two only for shaped values."""
    ok = F.coalesce(has_name_shape(c), F.lit(False))
    no = F.lit(False)
    known = folded_in_name_lexicon(fold_arabic(c) if folded is None else folded)
    return F.struct(ok.alias("shape_ok"), F.when(ok, known).otherwise(no).alias("lexicon_hit"),
                    F.when(ok, has_arabic(c)).otherwise(no).alias("is_arabic"))


# --------------------------------------------------------------------------- places
KNOWN_CITIES = sorted({fold_arabic_literal(c) for c in V.CITIES_EN + V.CITIES_AR})
CITY_REGIONS = {fold_arabic_literal(city): region for city, region in V.CITY_REGION.items()}


def look_up_literal(table: dict[str, object], key: Column) -> Column:
    """Value of a small fixed table, or null."""
    pairs = ", ".join(f"{sql_text(k)}, {sql_text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def folded_is_city(folded: Column) -> Column:
    return folded.isin(KNOWN_CITIES)


def is_known_city(c: Column) -> Column:
    return folded_is_city(fold_arabic(c))


def region_of_city(c: Column) -> Column:
    """Region of a known city, else null."""
    return look_up_literal(CITY_REGIONS, fold_arabic(c))


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def sql_text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ADDRESS_FOLDED = [fold_arabic_literal(k) for k in V.ADDRESS_KEYWORDS]
# the first letters are tested first: it is the cheapest test to fail
_ADDRESS_ANY = "(?=[" + "".join(sorted({k[0] for k in _ADDRESS_FOLDED})) + "])" + NOT_IN_WORD_BEFORE + "(?:" + "|".join(rf"\Q{k}\E" for k in _ADDRESS_FOLDED) + ")"


def folded_address_places(folded: Column) -> Column:
    """Places (from 1) in the keyword list of the address keywords at a word start, or null.

    No keyword starts another, so one pass over the text finds each of them.
    """
    keywords = strings(_ADDRESS_FOLDED)
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(_ADDRESS_ANY), F.lit(0)))
    return F.when(folded.rlike(_ADDRESS_ANY),
                  F.array_sort(F.transform(found, lambda k: F.array_position(keywords, k))))


def address_keywords(c: Column) -> Column:
    """The address keywords found at a word start, in list order."""
    words = strings(V.ADDRESS_KEYWORDS)
    places = let(fold_arabic(c), lambda folded: F.coalesce(folded_address_places(folded), F.array().cast("array<bigint>")))
    return F.transform(places, lambda i: F.element_at(words, i.cast("int")))


def context_place(text: Column, start: Column, end: Column, entity: str) -> Column:
    """Place (from 1) in the keyword list of the first one found just before or after a span, or null."""
    first = F.greatest(start - V.CONTEXT_BEFORE, F.lit(0))
    segment = F.concat(F.substring(text, first + 1, start - first), F.lit(" "),
                       F.substring(text, end + 1, F.lit(V.CONTEXT_AFTER)))
    keywords = strings([fold_arabic_literal(k) for k in V.CONTEXT_KEYWORDS[entity]])
    def first_contained(folded):
        place = F.array_position(F.transform(keywords, lambda k: F.contains(folded, k)), True)
        return F.nullif(place, F.lit(0))
    # a value that fills its cell has nothing around it
    return F.when(F.trim(segment) != "", let(fold_arabic(segment), first_contained))


def context_keyword(text: Column, start: Column, end: Column, entity: str) -> Column:
    """First context keyword in the characters just before or just after a span."""
    place = context_place(text, start, end, entity)
    return F.try_element_at(strings(V.CONTEXT_KEYWORDS[entity]), place.cast("int"))


# --------------------------------------------------------------------------- column names
def column_hint(column: str, group: str) -> str | None:
    """The keyword of ``group`` a column name carries, or None.

    Column names are metadata, so this is decided while the plan is built: a
    keyword matches as a run of whole words, or written as one long word.
    """
    words = literal_tokens(column)
    phrase = f" {' '.join(words)} "
    for keyword in V.COLUMN_KEYWORDS[group]:
        wanted = literal_tokens(keyword)
        compact = "".join(wanted)
        if f" {' '.join(wanted)} " in phrase:
            return keyword
        if len(compact) >= V.COMPACT_KEYWORD_LENGTH and compact == "".join(words):
            return keyword
    return None
