"""Column expressions over dates and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Market zone and the local hour from which news counts for the next day.
MARKET_ZONE = "Asia/Jakarta"
CUTOFF_HOUR = 15


# Spellings of a wall-clock time: ISO with and without fraction or seconds, and the feed form.
CLOCK_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS",
                 "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS",
                 "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd")
_ZONE = r"(?i)(?<=\d\d:\d\d|\.\d{3}|\.\d{6}) ?(Z|UTC|GMT|[+-]\d\d(?::?\d\d)?)$"


def to_market_time(df: DataFrame, column: str, zone: str = MARKET_ZONE) -> Column:
    """Wall-clock time in ``zone``.

    A ``timestamp`` is an instant, whatever the session zone; a
    ``timestamp_ntz`` is read as UTC.  Texts have to go through `parse_instant` first.
    """
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(column))
    if kind != "timestamp":
        raise TypeError(f"{column} is {kind}; a timestamp is needed")
    return F.convert_timezone(None, F.lit(zone), F.col(column).cast("timestamp_ntz"))


def parse_instant(text: Column, formats: Sequence[str] = CLOCK_FORMATS, strict: bool = False) -> Column:
    """The instant, as ``timestamp_ntz`` in UTC, of a text such as ``2024-01-05T15:00:00+0700``.

    An offset (``+0700``, ``+07:00``, ``+07``, ``Z``, ``GMT``) is taken off; a text without
    one is UTC.  The session zone plays no part.  Null and blank texts are null; a text
    that fits no format is null too, or an error if ``strict``.
    """
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, +", "")
    zone = F.regexp_extract(plain, _ZONE, 1)
    clock = F.regexp_replace(plain, _ZONE, "")
    local = F.coalesce(*[F.try_to_timestamp(clock, F.lit(f)).cast("timestamp_ntz") for f in formats])
    hours = F.coalesce(F.regexp_extract(zone, r"^[+-](\d\d)", 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(zone, r"^[+-]\d\d:?(\d\d)$", 1).try_cast("int"), F.lit(0))
    offset = F.when(zone.startswith("-"), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    found = local - F.make_dt_interval(mins=offset)
    if not strict:
        return found
    wrong = F.raise_error(F.concat(F.lit("not an instant: "), text)).cast("timestamp_ntz")
    return F.when(found.isNull() & (F.length(plain) > 0), wrong).otherwise(found)


def shift_after_close(local_time: Column, cutoff_hour: int = CUTOFF_HOUR) -> Column:
    """The local date, or the next one from the cutoff hour on."""
    return F.date_add(F.to_date(local_time),
                      F.when(F.hour(local_time) >= cutoff_hour, 1).otherwise(0))


def roll_weekend(day: Column) -> Column:
    """Saturday and Sunday to the Monday after."""
    weekday = F.dayofweek(day)
    return F.date_add(day, F.when(weekday == 7, 2).when(weekday == 1, 1).otherwise(0))


def fractional_hour(local_time: Column) -> Column:
    return F.hour(local_time) + F.minute(local_time) / F.lit(60.0)


def parse_mixed_date(text: Column, formats: Sequence[str]) -> Column:
    """The first of the explicit formats that fits; null where none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])
