"""Format-preserving fake values as column expressions.

Valid IDs, IBANs and mobile numbers are permuted under the salt, so equal values
get equal fakes and different values different ones, on any executor and without a
shared table.  Names, and what is no valid identifier, are drawn from the salted
SHA-256 of the original: there are fewer fakes than originals of that kind.
"""

from pyspark.sql import Column, functions as F

from veilframe import fixed_values as V
from veilframe.functions.checks import compact_iban, iban_check_digits, iban_valid, luhn_check_digit, national_id_valid
from veilframe.functions.permute import permute_alphanumerics, permute_digits
from veilframe.functions.text import ALNUM, SPACE, has_arabic, let, normalize_digits, strip


def digest(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), c), 256)


def _digits_of(seed: Column) -> Column:
    # nine even digits from each 15 of 64 hexadecimal characters: 36 digits
    parts = [F.lpad((F.conv(F.substring(seed, 1 + 15 * i, 15), 16, 10).cast("bigint") % 10 ** 9).cast("string"), 9, "0")
             for i in range(4)]
    return F.concat(*parts)


def reformat_like(original: Column, compact: Column) -> Column:
    """Put the characters of ``compact`` where ``original`` has letters or numbers."""
    def add(acc, ch):
        used = ch.rlike(f"[{ALNUM}]")
        nth = F.substring(compact, acc["used"] + 1, F.lit(1))
        return F.struct((acc["used"] + F.when(used, 1).otherwise(0)).alias("used"),
                        F.concat(acc["text"], F.when(used, nth).otherwise(ch)).alias("text"))
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("text"))
    spread = F.aggregate(F.split(original, ""), start, add, lambda acc: F.concat(
        acc["text"], F.substring(compact, acc["used"] + 1, F.length(compact))))
    return F.when(original.rlike(f"^[{ALNUM}]*+\\z"), compact).otherwise(spread)


def fake_national_id(c: Column, salt: str) -> Column:
    """A checksum-valid ID that keeps a leading 1 or 2; different valid IDs get different ones."""
    def build(plain):
        first = F.substring(plain, 1, 1)
        digits = F.regexp_replace(plain, "[^0-9]", "")
        drawn = F.when(national_id_valid(plain), permute_digits(F.substring(digits, 2, 8), f"{salt}:id")) \
            .otherwise(F.substring(_digits_of(digest(c, salt)), 1, 8))
        return let(F.concat(F.when(first.isin("1", "2"), first).otherwise("1"), drawn), lambda b: F.concat(b, luhn_check_digit(b)))
    return let(normalize_digits(c), build)


def fake_mobile(c: Column, salt: str) -> Column:
    """Keeps the prefix up to the first 5 and the separators; the other digits become others, different ones different."""
    def build(plain):
        digits = F.regexp_replace(plain, r"(?U)\D", "")
        prefix = F.regexp_extract(digits, "^([^5]*5)", 1)
        rest = F.substring(digits, F.length(prefix) + 1, F.length(digits))
        return let(F.concat(prefix, permute_digits(rest, f"{salt}:mobile")), lambda new: reformat_like(plain, new))
    return let(normalize_digits(c), build)


def fake_iban(c: Column, salt: str) -> Column:
    """A mod-97-valid IBAN of the same bank, with the separators of the original; different valid ones get different ones."""
    def build(plain):
        compact = compact_iban(plain)
        bank, account = F.substring(compact, 5, 2), F.substring(compact, 7, 18)
        drawn = F.when(~iban_valid(plain), F.substring(_digits_of(digest(c, salt)), 1, 18)) \
            .when(account.rlike("[A-Z]"), permute_alphanumerics(account, f"{salt}:iban")).otherwise(permute_digits(account, f"{salt}:iban"))
        bban = F.concat(F.when(F.length(bank) == 2, bank).otherwise(V.DEFAULT_BANK_CODE), drawn)
        new = let(bban, lambda b: F.concat(F.lit("SA"), iban_check_digits(b), b))
        return let(new, lambda n: reformat_like(plain, n))
    return let(normalize_digits(c), build)


def _pick(pool: list[str], seed: Column, place) -> Column:
    drawn = F.conv(F.substring(F.sha2(F.concat(seed, F.lit(":"), place.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
    return F.get(F.array(*[F.lit(w) for w in pool]), (drawn % len(pool)).cast("int"))


def _name_from(first: list[str], family: list[str], joint: str, extra: Column, seed: Column) -> Column:
    middle = F.transform(F.sequence(F.lit(1), extra),
                         lambda i: F.concat(F.lit(f" {joint} "), _pick(first, seed, i)))
    middle = F.when(extra > 0, F.array_join(middle, "")).otherwise("")
    return F.concat(_pick(first, seed, F.lit(0)), middle, F.lit(" "), _pick(family, seed, F.lit(-1)))


def fake_name(c: Column, salt: str) -> Column:
    """A made-up name in the same script with as many parts as the original."""
    words = F.size(F.split(strip(c), rf"(?U)[{SPACE}]+"))
    extra = F.greatest(words - 2, F.lit(0))

    def build(seed):
        return F.when(has_arabic(c), _name_from(V.FAKE_AR_FIRST, V.FAKE_AR_FAMILY, "بن", extra, seed)).otherwise(
            _name_from(V.FAKE_EN_FIRST, V.FAKE_EN_FAMILY, "bin", extra, seed))
    return let(digest(c, salt), build)


STATELESS_FAKES = {
    "SAUDI_NATIONAL_ID": fake_national_id, "SAUDI_MOBILE": fake_mobile, "SAUDI_IBAN": fake_iban,
    "ARABIC_PERSON_NAME": fake_name, "PERSON_NAME": fake_name,
}
