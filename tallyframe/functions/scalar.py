"""Scalar functions over columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words, as a regular expression.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# First hour (inclusive), end hour (exclusive), band name.
HOUR_BANDS = ((6, 12, "morning"), (12, 18, "afternoon"), (18, 22, "evening"))
NIGHT = "night"


# --- numbers ---------------------------------------------------------------

def log_shift(minimum: float | None) -> float:
    """What to add so that a column with this minimum can take a logarithm."""
    return abs(minimum) + 1 if minimum is not None and minimum <= 0 else 0


def shifted_log(c: Column, minimum: float | None) -> Column:
    return F.ln(c + F.lit(float(log_shift(minimum))))


def clip(c: Column, lower: float | None, upper: float | None) -> Column:
    """Limit to the bounds; null stays null (``least``/``greatest`` would fill it)."""
    out = c
    if upper is not None:
        out = F.when(c > F.lit(upper), F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(c < F.lit(lower), F.lit(lower)).otherwise(out)
    return out


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def indicator_above(c: Column, threshold: float) -> Column:
    """1 where the value is above the threshold, else 0; null is not above."""
    return F.coalesce(c.cast("double") > F.lit(float(threshold)), F.lit(False)).cast("int")


# --- time ------------------------------------------------------------------

def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def hour_band(hour: Column, names: Mapping[str, str] | None = None) -> Column:
    """Band of the day; ``names`` may rename the bands, e.g. to colours."""
    names = dict(names or {})
    out = F.lit(names.get(NIGHT, NIGHT))
    for first, end, band in reversed(HOUR_BANDS):
        out = F.when((hour >= first) & (hour < end), F.lit(names.get(band, band))).otherwise(out)
    return out


# --- text ------------------------------------------------------------------

def words(c: Column) -> Column:
    """Lower-case words of a text, split on white space, without empty ends."""
    return F.array_remove(F.split(F.lower(c), WHITESPACE), "")


def to_text(c: Column, null_label: str | None = None) -> Column:
    text = c.cast("string")
    return text if null_label is None else F.coalesce(text, F.lit(null_label))


def to_fixed(c: Column, digits: int = 2) -> Column:
    """Text with a fixed number of decimals and no thousands separator."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def point_label(parts: Mapping[str, Column]) -> Column:
    """``name: value`` lines joined by ``<br>``; a null value shows as ``nan``."""
    lines = [F.concat(F.lit(f"{name}: "), to_text(c, "nan")) for name, c in parts.items()]
    return F.concat_ws("<br>", *lines)


def join_names(names: Sequence[str]) -> str:
    return "_".join(names)


# --- conditions, lookups, arrays -------------------------------------------

def lookup(c: Column, table: Mapping, default) -> Column:
    """Value of a small fixed mapping, with a default for unknown or null keys."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def item_count(c: Column) -> Column:
    return F.size(c)


def fill_null(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def stable_bucket(key: Column, buckets: int) -> Column:
    """Bucket from a digest of the key: the same on every run and partitioning."""
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(digest, F.lit(buckets)).cast("int")
