"""Calendar helpers: date/time parsing, period keys, calendar flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO dates; by default a clock time may follow (see ISO_DATE).
DEFAULT_DATE_FORMATS = ("yyyy-M-d",)

# Strict clock time first, then the lenient forms a hand-typed POS export carries.
DEFAULT_TIME_FORMATS = ("H:mm:ss", "H:mm", "h:mm a", "h:mm:ss a")

# Calendar-month flags of the feature tables (flag name -> month number):
# Sinhala and Tamil New Year in April, Vesak in May, Christmas in December.
DEFAULT_MONTH_FLAGS = {
    "is_avurudu_month": 4,
    "is_vesak_month": 5,
    "is_christmas_month": 12,
}


# Text that cannot be a date or a clock time skips the formatters: a failed format
# costs a caught exception inside Spark, a regex test does not.
# The date of an ISO date or date-time, with T or a blank between, seconds and their fraction optional.
ISO_DATE = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})([T ]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?)?$"
TIME_SHAPE = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[AaPp][Mm])?$"


def _first_format(t: Column, formats: Sequence[str], shape: str | None) -> Column:
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(fmt)) for fmt in formats])
    return F.when(t.rlike(shape), parsed) if shape else parsed


def parse_date(c: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Text to DATE trying each format in order; unparseable -> NULL. The default takes
    ISO dates, also with a clock time behind them, which is left out."""
    t = F.trim(c.cast("string"))
    if tuple(formats) == DEFAULT_DATE_FORMATS:
        t = F.nullif(F.regexp_extract(t, ISO_DATE, 1), F.lit(""))
    return _first_format(t, formats, None).cast("date")


def parse_time_of_day(c: Column, formats: Sequence[str] = DEFAULT_TIME_FORMATS) -> Column:
    """Text clock time to seconds after midnight (BIGINT); unparseable -> NULL.

    A time-only pattern parses onto 1970-01-01, so the seconds since that day's
    midnight (a constant-folded timestamp) are the time of day.
    """
    t = F.trim(c.cast("string"))
    ts = _first_format(t, formats, TIME_SHAPE if formats == DEFAULT_TIME_FORMATS else None)
    return F.unix_seconds(ts) - F.unix_seconds(F.to_timestamp(F.lit("1970-01-01 00:00:00")))


def compose_timestamp(date_col: Column, seconds_of_day: Column) -> Column:
    """DATE plus seconds after midnight as TIMESTAMP_NTZ (each input read once)."""
    return F.timestamp_add("SECOND", seconds_of_day, date_col.cast("timestamp_ntz"))


def week_ending_sunday(d: Column) -> Column:
    """The Sunday closing the Monday-to-Sunday week of ``d``; a Sunday maps to itself."""
    return F.date_add(F.trunc(d.cast("date"), "week"), 6)


def month_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "month")


def in_last_week_of_month(d: Column) -> Column:
    """1 when ``d`` lies in the last seven days of its month, else 0 (TINYINT)."""
    return (F.dayofmonth(d) >= F.dayofmonth(F.last_day(d)) - 6).cast("tinyint")


def month_flags(d: Column, flags: dict[str, int] | None = None) -> dict[str, Column]:
    flags = DEFAULT_MONTH_FLAGS if flags is None else flags
    return {name: (F.month(d) == month).cast("tinyint") for name, month in flags.items()}
