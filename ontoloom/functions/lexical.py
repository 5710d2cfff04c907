"""Lexical forms of values, and values of lexical forms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def general_float(x: Column) -> Column:
    """A number in the shortest of fixed or exponent form with six significant digits, no trailing zeros.

    Halves are rounded up from the shortest decimal form of the number.
    """
    x = x.cast("double")
    sci = F.format_string("%.5e", x)
    exponent = F.element_at(F.split(sci, "e"), -1).cast("int")
    fixed = F.lit(None).cast("string")
    for e in range(-4, 6):
        fixed = F.when(exponent == e, F.format_string(f"%.{5 - e}f", x)).otherwise(fixed)
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)
    mantissa = bare(F.element_at(F.split(sci, "e"), 1))
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    long_power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.abs(exponent).cast("string"))
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(x == 0, "0")
        .when(fixed.isNotNull(), bare(fixed))
        .otherwise(F.concat(mantissa, F.when(F.abs(exponent) > 99, long_power).otherwise(power)))
    )


def date_time(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSxx")


def lexical(x: Column, kind: T.DataType) -> Column:
    """Text of a value: integers plain, booleans 0 or 1, numbers with six digits, times in milliseconds with offset."""
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return general_float(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return date_time(x)
    return x.cast("string")


def parse_prefix(s: Column, kind: T.DataType) -> Column:
    """The number that a text starts with, 0 if none; the first word of a text for words."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        got = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast(kind)
        return F.coalesce(got, F.lit(0.0).cast(kind))
    if isinstance(kind, T.BooleanType):
        low = F.lower(F.trim(s))
        return F.when(low.isin("true", "1"), True).otherwise(F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("int") != 0, F.lit(False)))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast(kind), F.lit(0).cast(kind))
    if isinstance(kind, T.TimestampType):
        # an offset as +hhmm is read too; a missing offset means the session's zone
        return F.try_to_timestamp(F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    if isinstance(kind, T.DateType):
        return s.try_cast("date")
    return s


def first_word(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*(\S+)", 1)


def hex_out(x: Column) -> Column:
    """Lower-case hexadecimal of an integer."""
    return F.lower(F.hex(x.cast("long")))


def hex_in(s: Column) -> Column:
    """Integer of a hexadecimal text; 0 if unreadable."""
    return F.coalesce(F.conv(F.regexp_extract(s, r"^\s*(?:0[xX])?([0-9a-fA-F]+)", 1), 16, 10).try_cast("long"), F.lit(0).cast("long"))


def mac_out(x: Column) -> Column:
    """A hardware address, six pairs of hexadecimal digits joined by colons, of an integer."""
    digits = F.lpad(hex_out(x), 12, "0")
    return F.concat_ws(":", *[F.substring(digits, k, 2) for k in range(1, 12, 2)])


def mac_in(s: Column) -> Column:
    """Integer of a hardware address, with colons, hyphens or nothing between its pairs; 0 if unreadable."""
    return hex_in(F.regexp_replace(s, "[:-]", ""))


def duration(seconds: Column) -> Column:
    """``Nd Hh Mm`` of a number of seconds."""
    s = seconds.cast("long")
    part = lambda x, u: F.concat(x.cast("string"), F.lit(u))
    return F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(F.pmod(s, F.lit(86400)) / 3600), "h"), part(F.floor(F.pmod(s, F.lit(3600)) / 60), "m"))


def percent_encode(s: Column) -> Column:
    """Percent-encoding with ``%20`` for a blank."""
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def percent_decode(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def erase(a: Column, start: int, count: int = 1) -> Column:
    """An array without ``count`` items from index ``start`` (from 0)."""
    return F.concat(F.slice(a, 1, start), F.slice(a, start + count + 1, F.greatest(F.size(a), F.lit(1))))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
