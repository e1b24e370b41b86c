"""Calendar periods in any time zone (R1 to R6): bounds of days, weeks, months and years as UTC instants."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ["year", "month", "week", "day"]  # the longest first
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def starts_on(day: Column, unit: str, week_start: str = "monday") -> Column:
    """The first local date of the period that a local date is in."""
    if unit == "week":
        return F.date_sub(day, F.pmod(F.weekday(day) - WEEKDAYS.index(week_start), F.lit(7)))
    return F.trunc(day, unit) if unit != "day" else day


def ends_before(start: Column, unit: str) -> Column:
    if unit in ("day", "week"):
        return F.date_add(start, 1 if unit == "day" else 7)
    return F.add_months(start, 1 if unit == "month" else 12)


def periods(days: DataFrame, zone: str, week_start: str = "monday") -> DataFrame:
    """One row per period that holds any of the local dates in ``days`` (column ``day``).

    unit, starts_on, ends_before, from, until: instants of local midnights. Days of 23 and 25 hours come out as they are.
    """
    rows = None
    for unit in UNITS:
        start = days.select(starts_on(F.col("day"), unit, week_start).alias("starts_on")).distinct()
        own = start.select(F.lit(unit).alias("unit"), "starts_on", ends_before(F.col("starts_on"), unit).alias("ends_before"))
        rows = own if rows is None else rows.unionByName(own)
    # Made from numbers in the zone itself, so that the session's own zone plays no part.
    part = lambda c: (F.year(c), F.month(c), F.day(c))
    instant = lambda c: F.make_timestamp(*part(c), F.lit(0), F.lit(0), F.lit(0), F.lit(zone))
    return rows.withColumn("from", instant("starts_on")).withColumn("until", instant("ends_before"))


def local_date(ms: Column, zone: str) -> Column:
    """The date in a zone of an instant in milliseconds."""
    utc = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def local_days(log: DataFrame, zone: str) -> DataFrame:
    return log.select(local_date(F.col("ts_ms"), zone).alias("day")).distinct()


def transitions(spark: SparkSession, zone: str, first: int, last: int) -> DataFrame:
    """Where the clocks of a zone change in the years from ``first`` to ``last``: instant, minutes before and after it.

    Offsets are compared an hour apart, and the hours in which they differ a minute apart: some 9,000 rows a year.
    """
    at = lambda y: F.make_timestamp(F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    utc = lambda ms: F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    offset = lambda ms: F.timestamp_diff("MINUTE", utc(ms), F.convert_timezone(F.lit("UTC"), F.lit(zone), utc(ms)))
    years = spark.range(first, last + 1).select(F.make_timestamp("id", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")).alias("y"))
    hours = years.select(F.explode(F.sequence(F.unix_millis("y"), F.unix_millis("y") + F.lit(366 * 24 * 3_600_000), F.lit(3_600_000))).alias("ms"))
    differing = hours.filter(offset(F.col("ms")) != offset(F.col("ms") + 3_600_000)).distinct()
    minutes = differing.select(F.explode(F.sequence(F.col("ms"), F.col("ms") + F.lit(3_540_000), F.lit(60_000))).alias("ms"))
    before, after = offset(F.col("ms")), offset(F.col("ms") + 60_000)
    found = minutes.filter(before != after).select((F.col("ms") + 60_000).alias("ms"), before.alias("minutes_before"), after.alias("minutes_after"))
    return found.filter(F.col("ms") < F.unix_millis(at(last + 1))).select(F.timestamp_millis("ms").alias("instant"), "minutes_before", "minutes_after")


def closed(rows: DataFrame, now: Column) -> DataFrame:
    """The periods that are over."""
    return rows.filter(F.col("until") <= now)


def require_closed(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` as they are, if all of these periods are over; one that isn't is refused (R2)."""
    open_ = rows.filter(F.col("until") > now).orderBy("until").first()
    if open_ is not None:
        raise ValueError(f"the {open_['unit']} from {open_['starts_on']} has not closed yet")
    return rows


def closing_with_days(rows: DataFrame) -> DataFrame:
    """For each day, the periods that end with it, longest first by ``rank``."""
    day = rows.filter("unit = 'day'").select(F.col("starts_on").alias("day"), "until")
    rank = F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit"))
    return rows.join(day, "until").select("day", "unit", "starts_on", "ends_before", "from", "until", rank.alias("rank"))


def previous(rows: DataFrame, zone: str, week_start: str = "monday") -> DataFrame:
    """Each period with the start of the one before it: the one that the last millisecond before it is in.

    So a date that a zone has skipped is never the one before.
    """
    day = local_date(F.unix_millis("from") - 1, zone)
    before = starts_on(day, "year", week_start)
    for unit in UNITS[1:]:
        before = F.when(F.col("unit") == unit, starts_on(day, unit, week_start)).otherwise(before)
    return rows.withColumn("previous_starts_on", before)


def selected(text: str) -> tuple[str, date]:
    """'2026', '2026-08' or '2026-08-23' to a unit and its first date; dates that don't exist are refused."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", text)
    if not m:
        raise ValueError(f"{text!r} is no year, month or day")
    unit = "day" if m[3] else "month" if m[2] else "year"
    return unit, date(int(m[1]), int(m[2] or 1), int(m[3] or 1))


def selected_period(spark: SparkSession, text: str, zone: str, week_start: str = "monday", week: bool = False) -> DataFrame:
    """The period that a text names in a zone, or the week of the day it names; dates that the zone has skipped are refused."""
    unit, first = selected(text)
    if week and unit != "day":
        raise ValueError(f"{text!r} names no day of a week")
    days = spark.createDataFrame([(first,)], "day date")
    own = periods(days, zone, week_start)
    at = own.filter("unit = 'day'").select(local_date(F.unix_millis("from"), zone).alias("day")).first()["day"]
    if at != first:
        raise ValueError(f"there is no {first} in {zone}")
    return own.filter(F.col("unit") == ("week" if week else unit))


def source_windows(rows: DataFrame) -> DataFrame:
    """The windows a period is read from: daily where its bounds are UTC midnights, else hourly.

    Periods whose bounds are no whole UTC hours get no windows.
    """
    whole = lambda seconds: (F.unix_seconds("from") % seconds == 0) & (F.unix_seconds("until") % seconds == 0)
    grain = F.when(whole(86_400), "daily").when(whole(3_600), "hourly")
    step = F.when(F.col("granularity") == "daily", F.expr("INTERVAL 24 HOUR")).otherwise(F.expr("INTERVAL 1 HOUR"))
    cut = rows.withColumn("granularity", grain).filter("granularity IS NOT NULL")
    return cut.withColumn("window_start", F.explode(F.sequence(F.col("from"), F.col("until") - step, step)))
