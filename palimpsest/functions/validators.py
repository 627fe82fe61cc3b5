"""Checks on matched strings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """The check digit of payment cards; false for anything but ASCII digits, and for the empty string."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False)) & digits.rlike("^[0-9]+$")


def mod97(account: Column) -> Column:
    """The check digits of international account numbers; spaces do not count."""
    compact = F.upper(F.replace(account, F.lit(" "), F.lit("")))
    rotated = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code <= 57, F.pmod(rest * 10 + (code - 48), F.lit(97))).otherwise(F.pmod(rest * 100 + (code - 55), F.lit(97)))

    rest = F.aggregate(F.filter(F.split(rotated, ""), lambda c: c != ""), F.lit(0), step)
    return compact.rlike("^[A-Z0-9]{15,34}$") & (rest == 1)


def ipv4(address: Column) -> Column:
    """Four numbers of 0 to 255 without leading zeros."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return address.rlike(rf"^{part}(\.{part}){{3}}$")


def ipv6(address: Column) -> Column:
    """Eight groups of hexadecimal digits, or fewer with one double colon."""
    groups = F.filter(F.split(address, ":"), lambda g: g != "")
    double = F.size(F.split(address, "::", -1)) - 1
    shaped = address.rlike("(?i)^[0-9a-f:]+$") & ~address.contains(":::") & F.forall(groups, lambda g: F.length(g) <= 4)
    whole = (double == 0) & (F.size(groups) == 8) & (F.size(F.split(address, ":", -1)) == 8)
    short = (double == 1) & (F.size(groups) <= 7) & ~address.rlike("^:[^:]|[^:]:$")
    return shaped & (whole | short)


def casefold(text: Column) -> Column:
    """Lower case for comparison: as Python's casefold for ASCII and Latin letters and for the sigmas; of rarer
    foldings only the sharp s and the long s are done."""
    lowered = F.lower(F.replace(F.replace(text, F.lit("ẞ"), F.lit("ss")), F.lit("ſ"), F.lit("s")))
    return F.replace(F.replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), F.lit("µ"), F.lit("μ"))
