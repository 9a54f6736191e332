"""Checksums as column expressions."""

from pyspark.sql import Column, functions as F

from veilframe.functions.text import SPACE, ascii_digits, let


def national_id_valid(c: Column) -> Column:
    """Ten digits starting 1 or 2 whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(ascii_digits(c), "[^0-9]", "")
    return let(digits, lambda d: d.rlike(r"^[12][0-9]{9}\z") & F.call_function("luhn_check", d))


def mod97(c: Column) -> Column:
    """Remainder by 97 of a number written with digits and letters (A=10 .. Z=35)."""
    return F.aggregate(
        F.split(c, ""), F.lit(0),
        lambda acc, ch: F.when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97)
                         .otherwise((acc * 100 + F.ascii(ch) - 55) % 97))


def compact_iban(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, rf"(?U)[{SPACE}]+", ""))


def iban_valid(c: Column) -> Column:
    """``SA``, two check digits, twenty more characters; remainder by 97 is one."""
    def check(iban):
        account, country_and_check = F.substring(iban, 5, 20), F.substring(iban, 1, 4)
        # SA reads 2810; thirteen digits at a time fit a long
        digits = F.concat(account, F.lit("2810"), F.substring(iban, 3, 2))
        rest = let(digits, lambda d: F.concat(
            (F.substring(d, 1, 13).try_cast("bigint") % 97).cast("string"), F.substring(d, 14, 13)).try_cast("bigint") % 97)
        return (F.when(iban.rlike(r"^SA[0-9]{22}\z"), rest == 1)
                .when(iban.rlike(r"^SA[0-9]{2}[0-9A-Z]{20}\z"), mod97(F.concat(account, country_and_check)) == 1)
                .otherwise(False))
    return let(compact_iban(ascii_digits(c)), check)


def iban_check_digits(bban: Column) -> Column:
    """Check digits that make ``SA`` + digits + ``bban`` valid."""
    return F.lpad((98 - mod97(F.concat(bban, F.lit("281000")))).cast("string"), 2, "0")


def luhn_check_digit(body: Column) -> Column:
    """Last digit that makes a nine-digit body pass the Luhn check."""
    digits = F.split(body, "")
    doubled = F.transform(digits, lambda ch, i: F.when(
        i % 2 == 0, ch.cast("int") * 2 - F.when(ch.cast("int") > 4, 9).otherwise(0)).otherwise(ch.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")
