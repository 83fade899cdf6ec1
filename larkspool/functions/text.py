"""Python text and number semantics as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip() sees it, line ends as str.splitlines() sees them.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BYTE_ORDER_MARK = "\ufeff"


def strip(text: Column) -> Column:
    """text without Unicode white space at either end; null stays null."""
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def lines(text: Column) -> Column:
    """Lines of text, split at every Unicode line end."""
    return F.split(text, LINE_END)


def rint_long(x: Column) -> Column:
    """x rounded to the nearest integer, ties to even."""
    return F.rint(x).cast("long")


def first_max(a: Column, b: Column) -> Column:
    """The larger of two doubles; a where either is NaN."""
    return F.when((b > a) & ~F.isnan(b), b).otherwise(a)  # NaN is above all others


def first_min(a: Column, b: Column) -> Column:
    """The smaller of two doubles; a where either is NaN."""
    return F.when((b < a) & ~F.isnan(a), b).otherwise(a)


def subtitle_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative times are 0, hours may take more than two digits."""
    ms = rint_long(first_max(F.lit(0.0), seconds) * F.lit(1000.0))
    parts = (ms, 3_600_000, 10**12), (ms, 60_000, 60), (ms, 1000, 60), (ms, 1, 1000)
    return F.format_string("%02d:%02d:%02d,%03d", *[F.floor(v / F.lit(unit)).cast("long") % F.lit(mod) for v, unit, mod in parts])


def clock(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on; whole seconds, ties to even, negative times are 0."""
    s = F.greatest(F.lit(0).cast("long"), rint_long(seconds))
    hour, minute, second = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(hour > 0, F.format_string("%d:%02d:%02d", hour, minute, second)).otherwise(F.format_string("%02d:%02d", minute, second))


def fixed(x: Column, digits: int) -> Column:
    """x with that many decimals, rounded on its exact binary value."""
    return F.call_function("format_number", x, F.lit("0" + ("." + "0" * digits if digits else "")))


def shortened(text: Column, length: int = 160) -> Column:
    """At most length characters, then an ellipsis if there were more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def stem(path: Column) -> Column:
    """File name without folders and its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def config_text(text: Column) -> Column:
    """Entries of a vocabulary or prompt text: lines without white space around them, blank and comment lines
    left out, joined by a comma. Null and texts of comments alone give ''."""
    entries = F.transform(lines(F.regexp_replace(text, r"\A\x{feff}", "")), strip)
    kept = F.filter(entries, lambda e: (e != "") & ~e.startswith("#"))
    return F.coalesce(strip(F.array_join(kept, ", ")), F.lit(""))
