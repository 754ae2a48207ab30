"""Identifier checksums as column expressions over a string of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the published weights
TFN = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE = (1, 3, 7, 9, 1, 3, 7, 9)
ABN = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN = (8, 7, 6, 5, 4, 3, 2, 1)


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _sum(d: Column, weights: tuple[int, ...]) -> Column:
    """Weighted sum of the leading digits; one fold, so that expressions stay small."""
    w = F.expr(f"array({', '.join(map(str, weights))})")
    return F.aggregate(F.zip_with(F.slice(F.split(d, ""), 1, len(weights)), w, lambda c, x: c.cast("int") * x), F.lit(0), lambda s, x: s + x)


def _valid(d: Column, n: int, rule: Column) -> Column:
    """False, not an error, for anything but n digits."""
    return F.coalesce(F.when(d.rlike(f"^[0-9]{{{n}}}$"), rule), F.lit(False))


def tfn_valid(d: Column) -> Column:
    """Weighted sum divisible by 11."""
    return _valid(d, 9, _sum(d, TFN) % 11 == 0)


def medicare_valid(d: Column) -> Column:
    """The ninth digit is the weighted sum of the first eight modulo 10."""
    return _valid(d, 10, _sum(d, MEDICARE) % 10 == _digit(d, 8))


def abn_valid(d: Column) -> Column:
    """Weighted sum divisible by 89, the first digit lessened by one, 0 to 9."""
    return _valid(d, 11, (_sum(d, ABN) + F.when(_digit(d, 0) == 0, 9 * ABN[0]).otherwise(-ABN[0])) % 89 == 0)


def acn_valid(d: Column) -> Column:
    """The ninth digit completes the weighted sum of the first eight to a multiple of 10."""
    return _valid(d, 9, (10 - _sum(d, ACN) % 10) % 10 == _digit(d, 8))


def luhn_valid(d: Column) -> Column:
    """False for the empty string."""
    return F.coalesce(F.when(d.rlike("^[0-9]+$"), F.call_function("luhn_check", d)), F.lit(False))


def iban_valid(text: Column) -> Column:
    """Mod 97 over the rearranged value, folded so that no number exceeds nine digits."""
    v = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    spelled = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.split(F.array_join(spelled, ""), ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(acc))
    return F.coalesce(F.when(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1), F.lit(False))


def post_validate(kind: Column, value: Column) -> Column:
    """Type of an identifier that a model proposed: itself, its invalid class, or null where the shape is wrong.

    TFN: 8 digits pass, 9 pass or are invalid by checksum. Medicare: 10 or 11 digits with a first digit from 2 to 6, the
    first ten by checksum. Account: 5 to 16 digits. Passport: up to 9 digits. Driver licence: up to 10 letters and
    digits. Other classes stay as they are; null stays null.
    """
    # fixed values: the limits above
    d = F.regexp_replace(value, "[^0-9]", "")
    n, letters = F.length(d), F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    checked = lambda ok, good: F.when(ok, F.lit(good)).otherwise(F.lit(f"{good}_INVALID"))
    return (
        F.when(kind == "AU_TFN", F.when(n == 8, kind).when(n == 9, checked(tfn_valid(d), "AU_TFN")))
        .when(kind == "AU_MEDICARE", F.when(n.isin(10, 11) & d.rlike("^[2-6]"), checked(medicare_valid(F.substring(d, 1, 10)), "AU_MEDICARE")))
        .when(kind == "AU_BANK_ACCOUNT", F.when(n.between(5, 16), kind))
        .when(kind == "PASSPORT", F.when(n <= 9, kind))
        .when(kind == "AU_DRIVERS_LICENCE", F.when(letters <= 10, kind))
        .otherwise(kind)
    )
