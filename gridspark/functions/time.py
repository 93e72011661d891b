"""Reference times (numbers since a date) and dates, in the calendars of the CF conventions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import REFERENCE

#: Microseconds of a unit; years are of 365.242198781 days, months a twelfth of that.
MICROSECONDS = {
    "microsecond": 1,
    "millisecond": 1000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "month": 2_629_743_831_223,
    "year": 31_556_925_974_678,
}
REAL = ("standard", "gregorian", "proleptic_gregorian", None)
#: Days before each month, in years of 365 and 366 days.
DAYS_BEFORE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def parsed(units: str) -> tuple[int, str]:
    """(microseconds of one unit, reference date as text) of units such as "days since 1970-01-01"."""
    m = REFERENCE.match(units)
    if not m:
        raise ValueError(f"{units!r} are no reference time units")
    unit = m[1].lower().removesuffix("s")
    unit = {"h": "hour", "hr": "hour", "min": "minute", "d": "day", "sec": "second", "": "second"}.get(unit, unit)
    return MICROSECONDS[unit], m[2]


def reference(text: str) -> dt.datetime:
    """The date of the units. A UTC offset is refused; year, month and day are needed."""
    out = dt.datetime.fromisoformat(text.replace("Z", "").strip())
    if out.tzinfo is not None:
        raise ValueError("a reference date with a UTC offset is not taken")
    return out


def _epoch(text: str) -> int:
    return (reference(text) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def decode(x: Column, units: str, calendar: str | None = None) -> Column:
    """Timestamps without a time zone of numbers since a date, in a calendar of the real world, to the microsecond."""
    if calendar not in REAL:
        raise ValueError(f"{calendar} dates are no timestamps; use fields()")
    step, since = parsed(units)
    return F.timestamp_micros((F.lit(_epoch(since)) + F.round(x.cast("double") * step).cast("long")).cast("long"))


def encode(t: Column, units: str) -> Column:
    step, since = parsed(units)
    return (F.unix_micros(t) - F.lit(_epoch(since))) / F.lit(step)


def rebase(x: Column, old: str, new: str) -> Column:
    """The same times as numbers in other reference units: a scale and a shift, without dates."""
    (a, since_a), (b, since_b) = parsed(old), parsed(new)
    shift = _epoch(since_a) - _epoch(since_b)
    return x * F.lit(a / b) + F.lit(shift / b) if a != b else x + F.lit(shift / b)


def fields(x: Column, units: str, calendar: str) -> Column:
    """struct<year, month, day, second double> in the calendars of equal years: 360_day, noleap (365_day) and all_leap (366_day), by whole-number arithmetic."""
    step, since = parsed(units)
    parts = [int(p) for p in since.split()[0].split("T")[0].split("-")]
    year_days = {"360_day": 360, "noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366}[calendar]
    before = [30 * m for m in range(12)] if year_days == 360 else [d + (year_days == 366 and m > 1) for m, d in enumerate(DAYS_BEFORE)]
    start = parts[0] * year_days + before[parts[1] - 1] + parts[2] - 1
    micros = F.round(x.cast("double") * step).cast("long")
    days = F.floor(micros / F.lit(86_400_000_000)).cast("long") + start
    year = F.floor(days / F.lit(year_days)).cast("long")
    of_year = F.pmod(days, F.lit(year_days))
    month = F.lit(1)
    for m, d in enumerate(before[1:], 2):
        month = F.when(of_year >= d, m).otherwise(month)
    day = of_year - F.element_at(F.array(*map(F.lit, before)), month) + 1
    return F.struct(year.alias("year"), month.alias("month"), day.cast("int").alias("day"), (F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1e6)).alias("second"))


def from_text(text: Column) -> Column:
    """Timestamps of ISO dates; NULL for what is none, and for dates with a UTC offset."""
    plain = text.rlike(r"^\s*-?\d{1,4}-\d{1,2}-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d+)?)?)?)?\s*$")
    return F.when(plain, F.try_to_timestamp(F.trim(text)))


def to_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def first_present(value: Column, order: Column) -> Column:
    """The aggregate that gives the first value that is not missing."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def to_reftime(df: DataFrame, value: str, order: list[str], units: str | None = None) -> tuple[DataFrame, str]:
    """(df with ISO dates, dates or timestamps as numbers since a date, their units). Without units they are days since the day of the first value present in the given order, or since 1970 if there is none; one aggregate finds it."""
    t = from_text(F.col(value)) if dict(df.dtypes)[value] == "string" else F.col(value).cast("timestamp")
    if units is None:
        first = df.agg(F.date_format(F.min_by(t, F.when(t.isNotNull(), F.struct(*order))), "yyyy-MM-dd")).first()[0]
        units = f"days since {first or '1970-01-01'}"
    return df.withColumn(value, encode(t, units)), units
