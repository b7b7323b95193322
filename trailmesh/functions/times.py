"""Times as epoch seconds, in UTC whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(text: Column) -> Column:
    """Epoch seconds of ISO text; a trailing ' UTC...' is cut off, and a time that names no zone is UTC."""
    plain = F.regexp_replace(F.regexp_replace(text, " UTC.*", ""), " ", "T")
    return F.unix_timestamp(F.to_timestamp(F.when(plain.rlike(r"(Z|T.*[+-]\d\d:?\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))))


def of_local(time: Column) -> Column:
    """Epoch seconds of a timestamp without zone, taken as UTC."""
    time = time.cast("timestamp_ntz")
    return F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))


def hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86_400)) / 3600)


def day_name(ts: Column) -> Column:
    """Year, month and day without leading zeros: 2024-3-7."""
    return F.concat_ws("-", F.year(date(ts)), F.month(date(ts)), F.dayofmonth(date(ts)))


def text(ts: Column) -> Column:
    """As 2024-03-07 08:15:00 UTC."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.format_string("%s %s:%s:%s UTC", date(ts).cast("string"), two(hour(ts)), two(F.floor(F.pmod(ts, F.lit(3600)) / 60)), two(F.pmod(ts, F.lit(60))))


def hours_minutes(seconds: Column) -> Column:
    """struct<h, m>: whole hours, and the minutes left rounded half to even."""
    return F.struct(F.floor(seconds / 3600).alias("h"), F.bround(F.pmod(seconds, F.lit(3600)) / 60).cast("long").alias("m"))
