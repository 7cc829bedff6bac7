"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the three tokenizers (non-word characters, non-letters, other than ASCII letters and apostrophe).
WORD, LETTER, ASCII = r"\W+", r"[^\p{L}]+", r"[^a-zA-Z']+"


def tokens(text: Column, separator: str = LETTER) -> Column:
    """The non-empty parts of a text between separators; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def is_blank(text: Column) -> Column:
    """Whether nothing but characters up to U+0020 is there."""
    return text.rlike(r"^[\x00-\x20]*$")


def format_count(key: Column, value: Column) -> Column:
    return F.concat(key.cast("string"), F.lit(": "), value.cast("string"))


def key_value(key: Column, value: Column, separator: str = ",") -> Column:
    """``key,value``; null is written as nothing."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(separator), F.coalesce(value.cast("string"), F.lit("")))


def record_line(value: Column, key: Column | None = None, separator: str = " ") -> Column:
    """A message as a line: ``key value`` or ``value`` alone; null is written as nothing."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return blank(value) if key is None else F.concat(blank(key), F.lit(separator), blank(value))


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def parse_instant(text: Column) -> Column:
    """An ISO instant (with offset or ``Z``; without one, in the session's zone); null if it isn't one."""
    return text.try_cast("timestamp")


def format_instant(at: Column) -> Column:
    """ISO with milliseconds and ``Z``, in UTC."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(at: Column, seconds: bool = True) -> Column:
    return F.date_format(at, "HH:mm:ss" if seconds else "HH:mm")


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Decimal places, half away from zero."""
    return F.round(value, digits)


def first_part(text: Column, separator: str = ":") -> Column:
    return F.substring_index(text, separator, 1)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a code point beyond U+FFFF counts twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial string hash with multiplier 31, of BMP texts."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: (acc * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("int")


def hash_bucket(text: Column, n: int, compatible: bool = False) -> Column:
    """A bucket from 0 to n-1; ``compatible`` masks the string hash with MAX_INT % n, as existing keys may do."""
    if compatible:
        return string_hash(text).bitwiseAND((2**31 - 1) % n)
    return F.pmod(F.xxhash64(text), F.lit(n)).cast("int")
