"""Keyed permutations of short texts of digits, as column expressions.

A Feistel network: the text is cut in two halves, and in turns one half is shifted
by a number drawn from the salt and the other half.  Every step can be undone, so
different texts of one length always give different texts, on any executor and
without a shared table.  Whoever knows the salt can undo all of it.
"""

from pyspark.sql import Column, functions as F

from veilframe.functions.text import let

ROUNDS = 10
#: Characters that one network takes: a half of this many digits must fit a 64-bit number, also twice.
LONGEST = {10: 36, 36: 20}
#: Steps of a walk to the next text that is allowed; a step fails with a chance below one in a thousand million.
STEPS = 3


def _network(text: Column, key: str, radix: int) -> Column:
    def build(t):
        size = F.length(t)
        left = F.floor(size / 2).cast("int")
        one, other = F.pow(F.lit(float(radix)), left).cast("bigint"), F.pow(F.lit(float(radix)), size - left).cast("bigint")
        number = (lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0))) if radix == 10 else lambda x: F.coalesce(F.conv(x, radix, 10).try_cast("bigint"), F.lit(0))
        written = (lambda x: x.cast("string")) if radix == 10 else lambda x: F.conv(x.cast("string"), 10, radix)

        def shifted(half, by, i, most, width):
            drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}:{radix}:"), size.cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), by), 256), 1, 15), 16, 10).cast("bigint")
            return F.lpad(written((number(half) + drawn % most) % most), width, "0")

        def turn(acc, i):
            return let(shifted(acc["a"], acc["b"], i, one, left), lambda a: F.struct(a.alias("a"), shifted(acc["b"], a, i + 1, other, size - left).alias("b")))
        start = F.struct(F.substring(t, F.lit(1), left).alias("a"), F.substring(t, left + 1, size).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 2), F.lit(2)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))
    return let(text, build)


def permute_digits(text: Column, key: str) -> Column:
    """A text of decimal digits as another of the same length; texts longer than one network takes are cut into pieces."""
    longest = LONGEST[10]
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / longest).cast("int")),
                         lambda i: _network(F.substring(text, i * longest + 1, F.lit(longest)), key, 10))
    return F.when(text == "", text).when(F.length(text) <= longest, _network(text, key, 10)).otherwise(F.array_join(pieces, ""))


def permute_alphanumerics(text: Column, key: str) -> Column:
    """A text of digits and capital letters, with a letter among them, as another such text; up to 20 characters.

    The network may give a text of digits only; the walk goes on from there until it
    meets one with a letter, which keeps different texts different.
    """
    def on(acc, _):
        return F.when(acc.rlike("[A-Z]"), acc).otherwise(_network(acc, key, 36))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _network(text, key, 36), on)
