"""Scalar helpers: boundary-counting differences, guarded arithmetic, seeded order keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minute_diff(start, end) -> Column:
    """Minute boundaries between two timestamps; negative when end is earlier."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", _c(start)), F.date_trunc("minute", _c(end)))


def second_diff(start, end) -> Column:
    """Second boundaries between two timestamps."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", _c(start)), F.date_trunc("second", _c(end)))


def epoch(ts) -> Column:
    """Seconds since 1970 of a timestamp without zone, as double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz")) / F.lit(1e6)


def dow_sunday0(ts) -> Column:
    """Day of week with Sunday 0."""
    return F.dayofweek(_c(ts)) - 1


def safe_div(a, b) -> Column:
    """a / b, null for a zero or null divisor."""
    return F.try_divide(_c(a), _c(b))


def nan_to_null(x) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def order_key(seed: int, *cols) -> Column:
    """A reproducible random order: md5 of the values and a seed."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols], F.lit(str(seed))))


def bucket(ts, width: str) -> Column:
    """Start of the tumbling bucket of a width like '5 minutes'. One per select."""
    return F.window(_c(ts), width)["start"]


def truncated_text(ts) -> Column:
    """'YYYY-MM-DD HH:MM:SS', without fractions."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def to_number(x) -> Column:
    """Lenient number: null where the text is none."""
    return _c(x).try_cast("double")


def to_time(x) -> Column:
    """Lenient timestamp: null where the text is none."""
    return _c(x).try_cast("timestamp_ntz")
