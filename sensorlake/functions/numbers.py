"""Numeric helpers: rounding, clamping, locale-aware parse and format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c) -> Column:
    """Round to two places, HALF_UP (Spark's ``round``; Python's ``round`` is half-even
    on the binary value, so 2.675 gives 2.68 here and 2.67 there)."""
    return F.round(_col(c), 2)


def clamp(c, lo=None, hi=None) -> Column:
    """Clamp into ``[lo, hi]`` keeping NULL as NULL (``greatest``/``least`` skip NULLs)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def parse_number(c, decimal_sep: str = ".", thousands_sep: str = "", dtype: str = "double") -> Column:
    """Localised number text to a number; NULL when it does not parse."""
    s = F.trim(_col(c))
    if thousands_sep:
        s = F.replace(s, F.lit(thousands_sep), F.lit(""))
    if decimal_sep != ".":
        s = F.replace(s, F.lit(decimal_sep), F.lit("."))
    return s.try_cast(dtype)


def localize(text, decimal_sep: str = ".", thousands_sep: str = "") -> Column:
    """Plain number text (``-1234.5``) with digit grouping and a decimal separator."""
    text = _col(text)
    if thousands_sep:
        whole = F.regexp_extract(text, r"^(-?\d+)", 1)
        frac = F.regexp_extract(text, r"^-?\d+\.(\d+)$", 1)
        whole = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1" + thousands_sep.replace("$", r"\$"))
        return F.when(frac == "", whole).otherwise(F.concat(whole, F.lit(decimal_sep), frac))
    if decimal_sep != ".":
        # Only the point changes: a character swap, no regex.
        if len(decimal_sep) == 1:
            return F.translate(text, ".", decimal_sep)
        return F.replace(text, F.lit("."), F.lit(decimal_sep))
    return text


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.transform(F.array(value), body)[0]


_SPLIT = 134217729.0  # 2^27 + 1: x * _SPLIT - (x * _SPLIT - x) has the upper 26 bits of x


def _rounded(f: Column, precision: int) -> Column:
    """f * 10^precision rounded to a whole number, for the exact f in [0, 1), ties to even.

    The product is the double p and a remainder that the halves of both factors give exactly;
    it decides where p lies at half a unit."""
    unit = 10.0**precision
    u1 = unit * _SPLIT - (unit * _SPLIT - unit)
    u2 = unit - u1

    def decide(f1: Column, p: Column, r: Column) -> Column:
        f2 = f - f1
        rest = ((f1 * F.lit(u1) - p) + f1 * F.lit(u2) + f2 * F.lit(u1)) + f2 * F.lit(u2)
        half = p - r
        return r + F.when((half == 0.5) & (rest > 0), 1.0).when((half == -0.5) & (rest < 0), -1.0).otherwise(0.0)

    upper = _let(f * F.lit(_SPLIT), lambda t: t - (t - f))
    return _let(upper, lambda f1: _let(f * F.lit(unit), lambda p: _let(F.rint(p), lambda r: decide(f1, p, r)))).cast("long")


def fixed_text(c, precision: int) -> Column:
    """The exact value of a double with ``precision`` digits after the point, ties to the even
    digit, as C's ``%.Nf`` writes it. From 2^63 on, and for more than 15 digits, the shortest
    decimal form is written out instead."""
    c = _col(c).cast("double")
    plain = F.format_string(f"%.{int(precision)}f", c)
    if precision > 15:
        return plain
    unit = 10**precision

    def joined(whole: Column, digits: Column) -> Column:
        carried = F.when(digits == unit, whole + 1).otherwise(whole).cast("string")
        behind = F.when(digits == unit, 0).otherwise(digits).cast("string")
        return F.concat(carried, F.lit("."), F.lpad(behind, precision, "0"))

    def text(x: Column) -> Column:
        whole = x.cast("long")
        if precision == 0:
            return F.when(x < F.lit(2.0**52), F.rint(x).cast("long")).otherwise(whole).cast("string")
        digits = _let(x - whole.cast("double"), lambda f: _rounded(f, precision))
        return _let(whole, lambda w: _let(digits, lambda d: joined(w, d)))

    sign = F.when(c.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    small = F.abs(c) < F.lit(2.0**63)
    # The shortest form has the same digits where its distance from the exact value, under a
    # thousandth of the last digit, can't reach half a unit: nearly all values.
    scaled = F.abs(c) * F.lit(float(unit))
    clear = (scaled < F.lit(2.0**43)) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > F.lit(2.0**-8))
    return F.when(clear, plain).when(small, F.concat(sign, _let(F.when(small, F.abs(c)).otherwise(0.0), text))).otherwise(plain)


def format_number(
    c,
    precision: int,
    decimal_sep: str = ".",
    thousands_sep: str = "",
    trim_zeros: bool = True,
) -> Column:
    """Number to text with ``precision`` digits after the point (``fixed_text``), trailing
    zeros trimmed, optional digit grouping and decimal separator. NaN and infinities
    keep Java's spelling."""
    c = _col(c)
    text = fixed_text(c, int(precision))
    if trim_zeros and precision > 0:
        # "8.17000" -> "8.17", "100.00000" -> "100": one regex, no second pass.
        text = F.regexp_replace(text, r"\.?0+$", "")
    finite = ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    if thousands_sep or decimal_sep != ".":
        text = F.when(finite, localize(text, decimal_sep, thousands_sep)).otherwise(text)
    return F.when(c.isNotNull(), text)
