"""Identifier spans in free text as column expressions.

A span is ``struct<start,end,entity,frag>`` with half-open code-point offsets.
Matches are bracketed by a marker character in one regex pass; splitting at the
marker gives the pieces between and inside matches, and their running lengths
give the offsets.  Text without a match costs one scan in generated code; only
text with matches enters the interpreted lambdas.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, functions as F

from veilframe import fixed_values as V
from veilframe.functions.checks import iban_valid, national_id_valid
from veilframe.functions.text import WORD, context_place, let, normalize_digits

SPAN_TYPE = "array<struct<start:int,end:int,entity:string,frag:string>>"
_MARK = "\x01"        # one plain character, so splitting needs no regex
_BLOCK = 128

_LOCAL = r"A-Za-z0-9._%+\-"


@dataclass(frozen=True)
class Pattern:
    """One entity found by pattern: how to find it, and how to check a match."""
    entity: str
    flags: str
    body: str
    shortest: int                   # bytes a match has at least; the size of a text is known without reading it
    needle: str                     # a quick pattern (or one plain character) that every match holds
    validator: Callable[[Column], Column] | None = None

    def candidate(self, text: Column) -> Column:
        """True for every text with a match, and cheap where there is none."""
        long_enough = F.octet_length(text) >= self.shortest
        if len(self.needle) == 1:
            return long_enough & F.contains(text, F.lit(self.needle))
        return long_enough & text.rlike(self.needle) & text.rlike(self.regex)

    @property
    def whole(self) -> str:
        """The pattern for text that is one match from start to end."""
        return rf"{self.flags}^{self.body}\z"

    @property
    def regex(self) -> str:
        return self.flags + self.body

    @property
    def weights(self):
        return V.PATTERN_WEIGHTS[self.entity]


# An e-mail can only start where a run of local-part characters starts or where
# the previous match ended; saying so keeps long runs linear.
PATTERNS: dict[str, Pattern] = {p.entity: p for p in (
    Pattern("SAUDI_NATIONAL_ID", "(?U)", r"(?<!\d)[12]\d{9}(?!\d)", 10, r"(?U)[12]\d{9}", national_id_valid),
    Pattern("SAUDI_MOBILE", "(?U)",
            r"(?<![\d+])(?:\+?966|00966|0)?[\s-]?5\d[\s-]?\d{3}[\s-]?\d{4}(?!\d)", 9,
            r"(?U)5\d[\s-]?\d{3}[\s-]?\d{4}(?!\d)"),
    Pattern("SAUDI_IBAN", "(?iuU)",
            rf"(?<![{WORD}])SA\d{{2}}\s?(?:[0-9A-Z]{{4}}\s?){{4}}[0-9A-Z]{{4}}(?![{WORD}])", 24,
            r"(?U)[sSſ][aA]\d{2}", iban_valid),
    Pattern("EMAIL_ADDRESS", "(?iu)",
            rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}", 6, "@"),
)}


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """``add`` over 0 and the first 1, 2, ... numbers of an array.

    Blocks are added up first, so that each number meets those of its own block
    and the results of the blocks before it, not all numbers before it.
    """
    def in_blocks(v):
        return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK)), lambda i: F.slice(v, i, _BLOCK))

    def total(v):
        return F.aggregate(v, F.lit(0), add)

    def from_blocks(blocks):
        def shifted(sums):
            return F.flatten(F.transform(blocks, lambda b, k: let(total(F.slice(sums, F.lit(1), k)), lambda before: F.transform(
                b, lambda _, i: add(before, total(F.slice(b, F.lit(1), i + 1)))))))
        return let(F.transform(blocks, total), shifted)

    return let(values, lambda v: F.when(F.size(v) > 0, let(in_blocks(v), from_blocks)).otherwise(v))


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array."""
    return _running(values, lambda acc, x: acc + x)


def running_maxima(values: Column) -> Column:
    """The largest of 0 and the first 1, 2, ... numbers of an array."""
    return _running(values, lambda acc, x: F.greatest(acc, x))


def _spans_from_pieces(pieces: Column, entity: str) -> Column:
    # pieces alternate: text outside, match, text outside, match, ...
    def spans(ends):
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(
            F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.lit(entity).alias("entity"), F.get(pieces, i).alias("frag")))

    found = let(running_sums(F.transform(pieces, F.length)), spans)
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast(SPAN_TYPE))


def find_spans(text: Column, entity: str) -> Column:
    """All spans of one entity in digit-normalised text, left to right."""
    pattern = PATTERNS[entity]
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, "\ufffd")).otherwise(text)
    marked = F.regexp_replace(clean, pattern.regex, f"{_MARK}$0{_MARK}")
    spans = let(F.split(marked, _MARK), lambda pieces: _spans_from_pieces(pieces, entity))
    return F.when(pattern.candidate(text), spans).otherwise(F.array().cast(SPAN_TYPE))


def all_spans(text: Column) -> Column:
    """Spans of every pattern entity, entity by entity, in digit-normalised text."""
    return F.concat(*[find_spans(text, entity) for entity in PATTERNS])


def may_hold_spans(text: Column) -> Column:
    """Cheap necessary test for any span at all."""
    any_of = [p.candidate(text) for p in PATTERNS.values()]
    result = any_of[-1]
    for test in any_of[:-1]:
        result = result | test
    return result


def resolve_overlaps(spans: Column) -> Column:
    """Sort by (start, end, entity) and keep each span that starts after the kept ones.

    A span that starts at or after the ends of all earlier ones starts a cluster,
    and only clusters of several spans are folded one by one.
    """
    def keep(acc, span):
        fits = span["start"] >= acc["end"]
        return F.when(fits, F.struct(span["end"].alias("end"), F.concat(acc["spans"], F.array(span)).alias("spans"))
                      ).otherwise(acc)

    def folded(cluster):
        start = F.struct(F.lit(-1).alias("end"), F.array().cast(SPAN_TYPE).alias("spans"))
        return F.aggregate(cluster, start, keep, lambda acc: acc["spans"])

    def by_cluster(ordered):
        def opens(reached):
            return F.filter(F.transform(ordered, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reached, i - 1)), i)), lambda i: i.isNotNull())

        reached = running_maxima(F.transform(ordered, lambda s: s["end"]))
        return let(let(reached, opens), lambda first: F.flatten(F.transform(first, lambda i, k: folded(
            F.slice(ordered, i + 1, F.coalesce(F.get(first, k + 1), F.size(ordered)) - i)))))

    return let(F.sort_array(spans), by_cluster)


def span_valid(frag: Column, entity: str) -> Column:
    """Checksum result; true for entities without a checksum."""
    check = PATTERNS[entity].validator
    return check(frag) if check else F.lit(True)


def span_context(text: Column, span: Column, entity: str) -> Column:
    """Place of the context keyword next to a span, or null."""
    return context_place(text, span["start"], span["end"], entity)


def count_spans(text: Column) -> Column:
    """Number of spans of all entities in a text that is not yet digit-normalised."""
    def count(plain):
        return sum((F.size(find_spans(plain, e)) for e in PATTERNS), F.lit(0))
    return F.when(may_hold_spans(normalize_digits(text)), let(normalize_digits(text), count)).otherwise(0)
