"""The shared row filter (F1 to F4, F10 to F12, F18, J1, J2) and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.requests import not_a_bot, shows_rendering, under_any
from sitelens.functions.text import any_of, decoded_path
from sitelens.functions.visitors import PAIR
from sitelens.plans.request import CURRENT_MONTH, Request, TimeRange


def pruned(log: DataFrame, span: TimeRange | str | None) -> DataFrame:
    """Partition pruning by the days of a span, then its exact bounds.

    The lists are literals on partition columns, so only the directories of those months and days are listed.
    """
    if span is None:
        return log
    if span == CURRENT_MONTH:
        today = F.date_from_unix_date(F.floor(F.unix_seconds(F.current_timestamp()) / 86_400).cast("int"))  # in UTC, as partitions are
        return log.filter((F.col("year") == F.date_format(today, "yyyy")) & (F.col("month") == F.date_format(today, "MM")))
    days = span.days()
    if {"year", "month", "day"} <= set(log.columns):
        for column, form in (("year", "%Y"), ("month", "%m"), ("day", "%d")):
            log = log.filter(F.col(column).isin(*sorted({d.strftime(form) for d in days})))
    return log.filter(F.col("ts_ms").between(span.start, span.end))


def narrowed(request: Request) -> Column:
    """Whether a row with its decoded ``path`` is within a request, but for its span and rendering."""
    keep = F.lit(True) if request.include_bots else not_a_bot(F.col("cs_user_agent"), request.bot_agents)
    if request.host is not None:
        keep &= F.col("x_host_header") == request.host
    if request.countries is not None:
        keep &= any_of(F.col("c_country"), request.countries)
    if request.paths:
        keep &= under_any(F.col("path"), request.paths)
    return keep


def rendered_pairs(log: DataFrame, beacon_path: str, by: Sequence[str] = ()) -> DataFrame:
    """The visitors (per window) that fetched what only a rendering browser fetches."""
    return log.filter(shows_rendering(beacon_path)).select(*by, *PAIR).distinct()


#: So many of the busiest senders are spread, each over so many tasks.
HOT_SENDERS, SPREAD = 1_000, 64


def _spread(rows: DataFrame, pairs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``lot``: rows of the busiest senders draw one, and their pairs stand once in each; all others are in lot 0."""
    busy = log.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *PAIR).limit(HOT_SENDERS).select(*PAIR, F.lit(True).alias("busy"))
    busy = F.broadcast(busy)  # HOT_SENDERS rows
    drawn = F.pmod(F.xxhash64("ts_ms", "cs_uri_stem"), F.lit(SPREAD)).cast("int")
    rows = rows.join(busy, PAIR, "left").withColumn("lot", F.when(F.col("busy"), drawn).otherwise(0)).drop("busy")
    lots = F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return rows, pairs.join(busy, PAIR, "left").withColumn("lot", F.explode(lots)).drop("busy")


def rows_for(log: DataFrame, request: Request, where: Sequence[Column] = (), by: Sequence[str] = ()) -> DataFrame:
    """The rows a request covers, with their decoded ``path``.

    ``by`` names window columns when many windows are computed at once; rendering then has to be shown in the same
    window. What shows rendering is not narrowed by host, path, country or bot.
    """
    log = pruned(log, request.span)
    rows = log
    if not request.include_bots:
        rows = rows.filter(not_a_bot(F.col("cs_user_agent"), request.bot_agents))
    if request.host is not None:
        rows = rows.filter(F.col("x_host_header") == request.host)
    if request.countries is not None:
        rows = rows.filter(any_of(F.col("c_country"), request.countries))
    for condition in where:
        rows = rows.filter(condition)
    rows = rows.withColumn("path", decoded_path(F.col("cs_uri_stem")))
    if request.paths:
        rows = rows.filter(under_any(F.col("path"), request.paths))
    if request.rendered_only:
        pairs, on = rendered_pairs(log, request.beacon_path, by), [*by, *PAIR]
        if request.spread_senders:
            rows, pairs = _spread(rows, pairs, log)
            rows = rows.join(pairs, [*on, "lot"], "left_semi").drop("lot")
        else:
            rows = rows.join(pairs, on, "left_semi")
    return rows


def with_rendered_flag(rows: DataFrame, log: DataFrame, beacon_path: str, by: Sequence[str] = ()) -> DataFrame:
    """All rows, with ``rendered``: whether their visitor showed rendering in the window."""
    flags = rendered_pairs(log, beacon_path, by).withColumn("rendered", F.lit(True))
    return rows.join(flags, [*by, *PAIR], "left").withColumn("rendered", F.coalesce("rendered", F.lit(False)))


def top(rows: DataFrame, measure: str, keys: Sequence[str], limit: int | None, by: Sequence[str] = ()) -> DataFrame:
    """The first rows by measure (highest first) and then keys (nulls last), per window of ``by``."""
    order = [F.col(measure).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    if not by:
        ranked = rows.orderBy(*order)
        return ranked if limit is None else ranked.limit(limit)
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def reranked(rows: DataFrame, added: Sequence[str], keys: Sequence[str], limit: int | None) -> DataFrame:
    """Merged rows in order: first added column descending, then keys with null as ''; unranked without either."""
    if not added or not keys:
        return rows
    ordered = rows.orderBy(F.col(added[0]).desc(), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return ordered if limit is None else ordered.limit(limit)
