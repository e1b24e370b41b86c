"""Registered queries of the analytics engine, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import events
from sitelens.functions.requests import browser_family, device_class, is_page_view
from sitelens.functions.text import parameter, raw_parameter, referrer_host
from sitelens.functions.visitors import day_salts, digest, has_address, salt
from sitelens.operators import compare, merge
from sitelens.operators.questions import Question, conversion_on_event, conversion_on_path, registry, visitors, web_vitals
from sitelens.operators.rows import pruned, reranked, rows_for, top
from sitelens.plans import calendar, reports
from sitelens.plans.identity import identity
from sitelens.plans.matrix import compute_matrix
from sitelens.plans.request import HOUR, Request, TimeRange, asked_span
from sitelens.plans.stored import answered
from sitelens.plans.windows import WINDOW, as_rows, compute, compute_visitors, coverage, due, matrix, overlapping, pending, recent, with_windows
from sitelens.sources.access_log import one_distribution
from sitelens.derived_log import DUCK_FLOODED, DUCK_LOG, access_log, flooded
from sitelens.sources.stores import ReportStore, SummaryStore, write_csv, write_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-10 to 2024-01-12, both ends counted.
SPAN = TimeRange(1_704_844_800_000, 1_705_017_600_000)
SECRET = "test secret"
ALL = Request(limit=None)


def query(name: str, oracle: str | None = None, log: str = DUCK_LOG):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = f"WITH {log}, " + oracle.lstrip() if oracle.lstrip().startswith("--cte") else f"WITH {log}\n{oracle}"
            ORACLES[name] = ORACLES[name].replace("--cte", "", 1)
        return function

    return register


# -- pieces of SQL that several twins share ------------------------------------------

PEOPLE = "NOT regexp_matches(lower(cs_user_agent), 'bot|crawl|spider|slurp')"
VIEW = "cs_method = 'GET' AND sc_content_type LIKE 'text/html%' AND sc_status IN ('200', '304')"
IN_SPAN = f"ts_ms BETWEEN {SPAN.start} AND {SPAN.end}"
RENDERED = """(c_ip, cs_user_agent) IN (SELECT (c_ip, cs_user_agent) FROM {log} WHERE c_ip IS NOT NULL AND cs_user_agent IS NOT NULL AND (
  regexp_matches(lower(cs_uri_stem), '\\.(css|js|mjs|woff|woff2|ttf|otf)$') OR starts_with(cs_uri_stem, '/_beacon')))"""
HOST = "nullif(regexp_extract(cs_referer, '^https?://([^/?#:\\[]+)', 1), '')"


_BROWSER = """CASE WHEN regexp_matches(lower(cs_user_agent), 'edg(e|a|ios)?/') THEN 'Edge' WHEN regexp_matches(lower(cs_user_agent), '(opr|opera|opios)/|opera(%20| )mini/') THEN 'Opera'
  WHEN contains(lower(cs_user_agent), 'samsungbrowser/') THEN 'Samsung Internet' WHEN regexp_matches(lower(cs_user_agent), '(firefox|fxios)/') THEN 'Firefox'
  WHEN regexp_matches(lower(cs_user_agent), '(chrome|crios|chromium)/') THEN 'Chrome family' WHEN contains(lower(cs_user_agent), 'safari/') THEN 'Safari family' ELSE 'Other' END"""
_DEVICE = """CASE WHEN regexp_matches(lower(cs_user_agent), 'ipad|tablet|kindle|silk/|playbook') THEN 'Tablet'
  WHEN regexp_matches(lower(cs_user_agent), 'mobile|iphone|ipod|windows(%20| )phone|blackberry|bb10') THEN 'Mobile' WHEN contains(lower(cs_user_agent), 'android') THEN 'Tablet'
  WHEN regexp_matches(lower(cs_user_agent), 'windows(%20| )nt|macintosh|x11|cros|linux') THEN 'Desktop' ELSE 'Other' END"""


def _once(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _raw(name: str) -> str:
    return f"coalesce(regexp_extract(cs_uri_query, '(?:^|&){name}=([^&]*)', 1), '')"


_V1 = " || ',' || ".join(_once(_raw(p)) for p in "epnsm")
_PACKED = f"CASE WHEN {_raw('v')} = '2' THEN {_once(_once(_raw('b')))} ELSE {_V1} END"
_FIELDS = ", ".join(f"{_once(f'split_part(packed, chr(44), {i + 1})')} AS {f}" for i, f in enumerate(("event", "page", "value", "subject", "message")))
EVENTS = f"""ev AS (
  SELECT *, {_FIELDS} FROM (SELECT *, unnest(string_split({_PACKED}, ';')) AS packed, {_raw("v")} AS version FROM log)
)"""
EVENT = "cs_method = 'GET' AND cs_uri_query <> '-' AND version <> '' AND event <> ''"
ON_BEACON = "starts_with(path, '/_beacon')"
NUMBER = "regexp_matches(value, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
WINDOWED = """win AS (
  SELECT *, 'hourly' AS granularity, date_trunc('hour', make_timestamp(ts_ms * 1000)) AS window_start FROM log
  UNION ALL SELECT *, 'daily', date_trunc('day', make_timestamp(ts_ms * 1000)) FROM log
)"""


def _top(columns: str, source: str, where: str, group: str, order: str, limit: int | None = 20) -> str:
    return f"SELECT {columns} FROM {source} WHERE {where} GROUP BY {group} ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


def _views(where: str = "TRUE", source: str = "log", limit: int | None = 20) -> str:
    return _top("path, count(*) AS views", source, f"{VIEW} AND {where}", "path", "views DESC, path NULLS LAST", limit)


def ask(name: str, request: Request = Request()) -> Query:  # noqa: B008
    return lambda spark, d: registry()[name].answer(access_log(spark, d), request)


# -- questions -------------------------------------------------------------------

query("a1_pageviews", _views(PEOPLE))(ask("pageviews"))
query("a1_pageviews_all_agents", _views())(ask("pageviews", Request(include_bots=True)))
query("a1_pageviews_extra_bots", _views(f"{PEOPLE} AND NOT contains(lower(cs_user_agent), 'fetcher')"))(ask("pageviews", Request(bot_agents=("Fetcher",))))
query("a1_pageviews_host", _views(f"{PEOPLE} AND x_host_header = 'blog.example.com'"))(ask("pageviews", Request(host="blog.example.com")))
query("a1_pageviews_paths", _views(f"{PEOPLE} AND (starts_with(path, '/words/café') OR starts_with(path, '/blog/'))"))(ask("pageviews", Request(paths=("/words/café", "/blog/"))))
query("a1_pageviews_countries", _views(f"{PEOPLE} AND c_country IN ('GB', 'DE')"))(ask("pageviews", Request(countries=("GB", "DE"))))
query("a1_pageviews_span", _views(f"{PEOPLE} AND {IN_SPAN}"))(ask("pageviews", Request(span=SPAN)))
query("a1_pageviews_rendered", _views(f"{PEOPLE} AND {RENDERED.format(log='log')}"))(ask("pageviews", Request(rendered_only=True)))
query("f3_current_month", _views(f"{PEOPLE} AND year = strftime(current_date, '%Y') AND month = strftime(current_date, '%m')"))(ask("pageviews", Request(span="current month")))


@query("f3_half_in_this_month", _views(f"{PEOPLE} AND day <= '15'"))
def f3(spark, d):
    """The first half of the log's month stands in the current month's partitions, the rest where it was."""
    now = F.date_from_unix_date(F.floor(F.unix_seconds(F.current_timestamp()) / 86_400).cast("int"))
    moved = lambda c, form: F.when(F.col("day") <= "15", F.date_format(now, form)).otherwise(F.col(c))
    log = access_log(spark, d).withColumns({"year": moved("year", "yyyy"), "month": moved("month", "MM")})
    return registry()["pageviews"].answer(log, Request(span="current month"))


query("a2_referrers", _top(f"{HOST} AS referrer, count(*) AS views", "log", f"{VIEW} AND {PEOPLE} AND cs_referer <> '-' AND {HOST} <> x_host_header", "1", "views DESC, referrer"))(ask("referrers"))
query("a3_browsers", _top(f"{_BROWSER} AS browser, {_DEVICE} AS device, count(*) AS views", "log", f"{VIEW} AND {PEOPLE}", "1, 2", "views DESC, browser, device"))(ask("browsers"))
query("a4_status_codes", _top("sc_status AS status, count(*) AS responses", "log", f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon')", "1", "responses DESC, status"))(ask("status-codes"))
_HITS, _MISSES = "sum(CASE WHEN x_edge_result_type IN ('Hit', 'RefreshHit') THEN 1 ELSE 0 END)", "sum(CASE WHEN x_edge_result_type = 'Miss' THEN 1 ELSE 0 END)"
_RATIO = f"CAST({_HITS} AS BIGINT) AS hits, CAST({_MISSES} AS BIGINT) AS misses, CAST(round(CAST(100.0 * {_HITS} AS DECIMAL(18, 6)) / nullif({_HITS} + {_MISSES}, 0), 1) AS DOUBLE) AS hit_percent"
query("a5_cache_hit_ratio", f"SELECT {_RATIO} FROM log WHERE {PEOPLE}")(ask("cache-hit-ratio"))
_TERM = _once(_once(_raw("q")))
_SEARCHED = f"cs_method = 'GET' AND cs_uri_query <> '-' AND {_TERM} <> '' AND {PEOPLE}"
_SEARCHES = "count(*) AS searches, CAST(sum(CASE WHEN sc_status IN ({codes}) THEN 1 ELSE 0 END) AS BIGINT) AS redirected"
query("a6_searches", _top(f"{_TERM} AS term, {_SEARCHES.format(codes=chr(39) + '302' + chr(39))}", "log", _SEARCHED, "1", "searches DESC, term"))(ask("searches"))
_SECTION = "CASE WHEN starts_with(path, '/search/') THEN '/search/' ELSE '/words/' END"
query("a6_searches_sections", _top(f"{_TERM} AS term, {_SECTION} AS section, {_SEARCHES.format(codes=chr(39) + '308' + chr(39))}", "log", f"{_SEARCHED} AND (starts_with(path, '/search/') OR starts_with(path, '/words/'))", "1, 2", "searches DESC, term, section"))(
    ask("searches", Request(paths=("/search/", "/words/"), redirects=("308",)))
)


def _extent(log: DataFrame) -> TimeRange:
    """The whole days from the first row of a log to its last; a log without times has the first day of all."""
    first, last = log.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    day = 24 * HOUR
    return TimeRange((first or 0) // day * day, (last or 0) // day * day + day - 1)


def _salts(log: DataFrame) -> DataFrame:
    return day_salts(log.sparkSession, SECRET, [d.strftime("%Y-%m-%d") for d in _extent(log).days()])


_VISIT = "CAST(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS STRING) || '|' || c_ip || '|' || cs_user_agent"


@query("a7_visitors", f"SELECT count(DISTINCT {_VISIT}) AS distinct_visitors FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-'")
def a7(spark, d):
    log = access_log(spark, d)
    return visitors(log, Request(), _salts(log))


@query("a7_visitors_period", f"SELECT count(DISTINCT c_ip || '|' || cs_user_agent) AS distinct_visitors FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-'")
def a7_period(spark, d):
    period = spark.createDataFrame([(salt(SECRET, "month", "UTC", "monday", "2024-01-01"),)], "salt string")
    return visitors(access_log(spark, d), Request(), period)


@query("a8_visitors_split", f"""SELECT count(DISTINCT CASE WHEN r THEN v END) AS distinct_visitors, count(DISTINCT CASE WHEN NOT r THEN v END) AS unrendered
FROM (SELECT {_VISIT} AS v, coalesce({RENDERED.format(log="log")}, false) AS r FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-')""")  # fmt: skip
def a8(spark, d):
    log = access_log(spark, d)
    return visitors(log, Request(rendered_only=True), _salts(log), split=True)


_CAPPED = f"""SELECT page, event, CAST(sum(least(n, 60)) AS BIGINT) AS events FROM (
  SELECT page, event, c_ip, cs_user_agent, ts_ms // 3600000 AS h, count(*) AS n FROM ev WHERE {EVENT} AND {PEOPLE} GROUP BY ALL
) GROUP BY page, event ORDER BY events DESC, page, event LIMIT 20"""
_TOTALS = f"""SELECT event, count(*) AS events, coalesce(sum(CASE WHEN {NUMBER} THEN CAST(value AS DOUBLE) END), 0) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY event, c_ip, cs_user_agent, ts_ms // 3600000 ORDER BY timestamp_ms, value) AS seen
  FROM ev WHERE {EVENT} AND {PEOPLE} AND {ON_BEACON} AND value <> '' AND event NOT IN ('lcp', 'cls', 'fcp', 'ttfb', 'error', 'rejection')
) WHERE seen <= 60 GROUP BY event ORDER BY total DESC, event LIMIT 20"""
_WITH_EVENTS = f"{DUCK_LOG}, {EVENTS}"
_FLOODED_EVENTS = f"{DUCK_LOG.replace('log AS', 'plain_log AS', 1)}, {DUCK_FLOODED}, {EVENTS}"
query("a9_beacon_events", _CAPPED, _WITH_EVENTS)(ask("beacon-events"))
query("a10_beacon_totals", _TOTALS, _WITH_EVENTS)(ask("beacon-totals"))
query("a9_beacon_events_flooded", _CAPPED, _FLOODED_EVENTS)(lambda spark, d: registry()["beacon-events"].answer(flooded(access_log(spark, d))))
query("a10_beacon_totals_flooded", _TOTALS, _FLOODED_EVENTS)(lambda spark, d: registry()["beacon-totals"].answer(flooded(access_log(spark, d))))
_VITALS = f"SELECT event AS vital, quantile_disc(CAST(value AS DOUBLE), 0.75) AS p75, count(*) AS samples FROM ev WHERE {EVENT} AND {PEOPLE} AND {ON_BEACON} AND event IN ('lcp', 'cls', 'fcp', 'ttfb') AND {NUMBER} AND value NOT LIKE '-%' GROUP BY 1"
query("a11_web_vitals_exact", _VITALS, _WITH_EVENTS)(lambda spark, d: Question("web-vitals-exact", web_vitals(exact=True), ranked=False).answer(access_log(spark, d)))
query("a11_web_vitals")(ask("web-vitals"))
query("a12_javascript_errors", _top("page, message, count(*) AS errors", "ev", f"{EVENT} AND {PEOPLE} AND {ON_BEACON} AND event IN ('error', 'rejection')", "1, 2", "errors DESC, page, message"), _WITH_EVENTS)(ask("javascript-errors"))


def _conversion(source: str, viewed: str, converted: str, extra: str = "", where: str = PEOPLE) -> str:
    group = f"{extra}, " if extra else ""
    named = f"{extra} AS device, " if extra else ""
    return f"""SELECT {"device, " if extra else ""}CAST(sum(CASE WHEN c > 0 AND v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS converted, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS visitors,
  CAST(round(CAST(100.0 * sum(CASE WHEN c > 0 AND v > 0 THEN 1 ELSE 0 END) AS DECIMAL(18, 6)) / nullif(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END), 0), 1) AS DOUBLE) AS converted_percent
FROM (SELECT {named}sum(CASE WHEN {viewed} THEN 1 ELSE 0 END) AS v, sum(CASE WHEN {converted} THEN 1 ELSE 0 END) AS c FROM {source}
  WHERE {where} AND c_ip <> '-' AND (({viewed}) OR ({converted})) GROUP BY {group}c_ip, cs_user_agent) {"GROUP BY device" if extra else ""}"""


_SEEN = f"{VIEW} AND NOT starts_with(cs_uri_stem, '/_beacon')"
_BOUGHT = f"{EVENT} AND starts_with(cs_uri_stem, '/_beacon') AND event = 'purchase'"
_CHECKOUT = "starts_with(path, '/do/checkout') AND cs_method = 'POST' AND sc_status IN ('303')"
query("a13_conversions_event", _conversion("ev", _SEEN, _BOUGHT), _WITH_EVENTS)(lambda spark, d: conversion_on_event("purchase").answer(access_log(spark, d)))
query("a13_conversions_event_host", _conversion("ev", _SEEN, _BOUGHT, where=f"{PEOPLE} AND x_host_header = 'www.example.com' AND c_country = 'GB'"), _WITH_EVENTS)(
    lambda spark, d: conversion_on_event("purchase").answer(access_log(spark, d), Request(host="www.example.com", countries=("GB",)))
)
query("a14_conversions_path", _conversion("log", _SEEN, _CHECKOUT))(lambda spark, d: conversion_on_path("/do/checkout", "post", ["303"]).answer(access_log(spark, d)))
query("a15_conversions_by_device", _conversion("log", _SEEN, _CHECKOUT, _DEVICE))(lambda spark, d: conversion_on_path("/do/checkout", "post", ["303"], by_device=True).answer(access_log(spark, d)))


@query("a16_custom_countries", _top("c_country AS country, count(*) AS views", "log", f"{VIEW} AND {PEOPLE} AND NOT starts_with(path, '/blog/')", "1", "views DESC, country"))
def a16(spark, d):
    def body(log, request, by):
        rows = rows_for(log, request, [is_page_view(), ~F.col("cs_uri_stem").startswith("/blog/")], by)
        return top(rows.groupBy(*by, F.col("c_country").alias("country")).agg(F.count(F.lit(1)).alias("views")), "views", ["country"], request.limit, by)

    own = registry()
    own.add(Question("countries", body, ("country",), ("views",)))
    return own["countries"].answer(access_log(spark, d))


# -- rows and columns ------------------------------------------------------------


@query("j3_events", f"SELECT event, page, value, subject, message, version, count(*) AS n FROM ev WHERE {EVENT} GROUP BY ALL", _WITH_EVENTS)
def j3(spark, d):
    rows = events.with_events(access_log(spark, d)).filter(events.is_event())
    return rows.groupBy(*events.FIELDS, "version").agg(F.count(F.lit(1)).alias("n"))


@query("p5_p6_ladders", f"SELECT cs_user_agent AS agent, {_BROWSER} AS browser, {_DEVICE} AS device, count(*) AS n FROM log GROUP BY 1, 2, 3")
def ladders(spark, d):
    agent = F.col("cs_user_agent")
    return access_log(spark, d).groupBy(agent.alias("agent"), browser_family(agent).alias("browser"), device_class(agent).alias("device")).agg(F.count(F.lit(1)).alias("n"))


@query("p1_p2_p4_decoding", f"SELECT path, {_TERM} AS term, {HOST} AS referrer, count(*) AS n FROM log GROUP BY 1, 2, 3")
def decoding(spark, d):
    rows = access_log(spark, d).withColumn("path", F.try_url_decode(F.try_url_decode("cs_uri_stem")))
    return rows.groupBy("path", parameter(F.col("cs_uri_query"), "q").alias("term"), referrer_host(F.col("cs_referer")).alias("referrer")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["p2_p4_page_urls"] = lambda spark, d: (
    spark.read.parquet(f"{d}/pages.parquet")
    .select(referrer_host(F.col("url")).alias("host"), F.coalesce(raw_parameter(F.try_parse_url("url", F.lit("QUERY")), "id"), F.lit("")).alias("id"))
    .groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("id") != "").cast("long")).alias("with_id"))
)
ORACLES["p2_p4_page_urls"] = r"""SELECT nullif(regexp_extract(url, '^https?://([^/?#:\[]+)', 1), '') AS host, count(*) AS pages,
CAST(sum(CASE WHEN coalesce(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS with_id FROM pages GROUP BY 1"""


@query("s5_one_distribution", f"SELECT distributionid, count(*) AS n, count(DISTINCT year || month || day || hour) AS hours FROM log WHERE distributionid = 'D2' AND {IN_SPAN} GROUP BY 1")
def s5(spark, d):
    rows = one_distribution(pruned(access_log(spark, d), SPAN), "D2")
    return rows.groupBy("distributionid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat("year", "month", "day", "hour")).alias("hours"))


@query("j2_rendered_rows", f"SELECT coalesce({RENDERED.format(log='log')}, false) AS rendered, count(*) AS n FROM log GROUP BY 1")
def j2(spark, d):
    from sitelens.operators.rows import with_rendered_flag

    log = access_log(spark, d)
    return with_rendered_flag(log, log, "/_beacon").groupBy("rendered").agg(F.count(F.lit(1)).alias("n"))


# -- windows -----------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY granularity, window_start ORDER BY {m} DESC, {k})"


def _month(granularities=("hourly", "daily")):
    span = TimeRange(1_704_067_200_000, 1_706_745_599_999)  # January 2024
    return [s for g in granularities for s in overlapping(span, g, 1_706_745_600_000)]


def _windows(log: DataFrame, granularities=("hourly", "daily")):
    """Every window of the days that a log covers."""
    span = _extent(log)
    return [s for g in granularities for s in overlapping(span, g, span.end + 1)]


_WIN_LOG = f"{DUCK_LOG}, {WINDOWED}"


def _windowed(columns: str, where: str, group: str, measure: str, keys: str, names: str, limit: int = 20) -> str:
    return f"""SELECT granularity, window_start, {names} FROM (
  SELECT *, {_RANK.format(m=measure, k=keys)} AS place FROM (SELECT granularity, window_start, {columns} FROM win WHERE {where} GROUP BY granularity, window_start, {group})
) WHERE place <= {limit}"""


def _naive(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("t4_backfill_pageviews", _windowed("path, count(*) AS views", f"{VIEW} AND {PEOPLE}", "path", "views", "path", "path, views", 3), _WIN_LOG)
def t4(spark, d):
    log = access_log(spark, d)
    return _naive(compute(log, registry()["pageviews"], Request(limit=3), _windows(log)))


@query("t4_backfill_statuses", _windowed("sc_status AS status, count(*) AS responses", f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon')", "sc_status", "responses", "status", "status, responses"), _WIN_LOG)
def t4_statuses(spark, d):
    log = access_log(spark, d)
    return _naive(compute(log, registry()["status-codes"], Request(), _windows(log)))


@query("t4_backfill_hit_ratio", f"SELECT granularity, window_start, {_RATIO} FROM win WHERE {PEOPLE} GROUP BY granularity, window_start", _WIN_LOG)
def t4_ratio(spark, d):
    log = access_log(spark, d)
    return _naive(compute(log, registry()["cache-hit-ratio"], Request(), _windows(log)))


@query("t4_backfill_rendered", f"""SELECT granularity, window_start, path, count(*) AS views FROM win w WHERE {VIEW} AND {PEOPLE} AND EXISTS (
  SELECT 1 FROM win x WHERE x.granularity = w.granularity AND x.window_start = w.window_start AND x.c_ip = w.c_ip AND x.cs_user_agent = w.cs_user_agent AND
  (regexp_matches(lower(x.cs_uri_stem), '\\.(css|js|mjs|woff|woff2|ttf|otf)$') OR starts_with(x.cs_uri_stem, '/_beacon'))) GROUP BY ALL""", _WIN_LOG)  # fmt: skip
def t4_rendered(spark, d):
    log = access_log(spark, d)
    return _naive(compute(log, registry()["pageviews"], Request(limit=None, rendered_only=True), _windows(log)))


@query("t6_window_visitors", f"SELECT granularity, window_start, count(DISTINCT {_VISIT}) AS distinct_visitors FROM win WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-' AND cs_user_agent IS NOT NULL GROUP BY 1, 2", _WIN_LOG)
def t6(spark, d):
    log = access_log(spark, d)
    return _naive(compute_visitors(log, Request(), _windows(log), _salts(log)))


@query("t1_windows", "SELECT granularity, window_start, count(*) AS n FROM win GROUP BY 1, 2", _WIN_LOG)
def t1(spark, d):
    return _naive(with_windows(access_log(spark, d)).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n")))


def _ledger(spark, spans):
    rows = as_rows(spark, spans)
    size = F.when(F.col("granularity") == "daily", 24 * HOUR).otherwise(HOUR)
    return rows.withColumn("window_end", F.timestamp_millis(F.unix_millis("window_start") + size)).withColumn("computed_at", F.timestamp_millis(F.unix_millis("window_end") + F.lit(15 * 60_000)))


@query("m1_range_by_windows", f"SELECT granularity, count(*) AS rows_covered FROM win WHERE (granularity = 'daily' AND window_start IN (DATE '2024-01-11', DATE '2024-01-12')) OR (granularity = 'hourly' AND (window_start BETWEEN TIMESTAMP '2024-01-10 22:00:00' AND TIMESTAMP '2024-01-10 23:00:00' OR window_start BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-13 01:00:00')) GROUP BY 1", _WIN_LOG)
def m1(spark, d):
    # 2024-01-10 21:30 to 2024-01-13 02:10: the half hours at both ends drop out
    spans = coverage(TimeRange(1_704_922_200_000, 1_705_111_800_000 + 60_000))
    rows = with_windows(access_log(spark, d))
    return rows.join(as_rows(spark, spans), WINDOW, "left_semi").groupBy("granularity").agg(F.count(F.lit(1)).alias("rows_covered"))


@query("m2_merge_statuses", _top("sc_status AS status, count(*) AS responses", "log", f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon')", "1", "responses DESC, status"))
def m2(spark, d):
    question = registry()["status-codes"]
    log = access_log(spark, d)
    spans = _windows(log, ("daily",))
    return merge.answer_from_windows(compute(log, question, ALL, spans), question, len(spans), 20)


@query("m2_merge_beacon_events", _CAPPED, _WITH_EVENTS)
def m2_events(spark, d):
    question = registry()["beacon-events"]
    log = access_log(spark, d)
    spans = _windows(log, ("hourly",))
    return merge.answer_from_windows(compute(log, question, ALL, spans), question, len(spans), 20)


@query("m3_merge_hit_ratio", f"SELECT {_RATIO} FROM log WHERE {PEOPLE}")
def m3(spark, d):
    question = registry()["cache-hit-ratio"]
    log = access_log(spark, d)
    spans = _windows(log, ("hourly",))
    return merge.answer_from_windows(compute(log, question, ALL, spans), question, len(spans))


@query("w3_ranked_merge", """SELECT path, CAST(sum(views) AS BIGINT) AS views FROM (
  SELECT path, views, row_number() OVER (PARTITION BY window_start ORDER BY views DESC, path) AS place
  FROM (SELECT path, window_start, count(*) AS views FROM win WHERE granularity = 'daily' AND """ + f"{VIEW} AND {PEOPLE}" + """ GROUP BY 1, 2)
) WHERE place <= 2 GROUP BY 1 ORDER BY views DESC, path LIMIT 3""", _WIN_LOG)  # fmt: skip
def w3(spark, d):
    question = registry()["pageviews"]
    log = access_log(spark, d)
    rows = compute(log, question, Request(limit=2), _windows(log, ("daily",)))
    return reranked(merge.added_up(rows, question), question.added, question.keys, 3)


@query("m7_gaps", "SELECT count(*) FILTER (WHERE n > 0) AS present, count(*) FILTER (WHERE n = 0 AND (h < lo OR h > hi)) AS skipped, count(*) FILTER (WHERE n = 0 AND h > lo AND h < hi) AS holes FROM (SELECT h, n, min(CASE WHEN n > 0 THEN h END) OVER () AS lo, max(CASE WHEN n > 0 THEN h END) OVER () AS hi FROM (SELECT r.h, count(l.ts_ms) AS n FROM (SELECT unnest(range(1704067200000, 1706745600000, 3600000)) AS h) r LEFT JOIN (SELECT ts_ms, ts_ms - ts_ms % 3600000 AS h FROM log WHERE sc_status = '404' AND c_country = 'GB') l USING (h) GROUP BY r.h))")
def m7(spark, d):
    # windows that hold a certain rare row play the part of the stored ones
    log = access_log(spark, d).filter((F.col("sc_status") == "404") & (F.col("c_country") == "GB"))
    return merge.gaps(as_rows(spark, _month(("hourly",))), with_windows(log, ["hourly"]).select(*WINDOW).distinct())


@query("m8_days_from_hours", """SELECT 'daily' AS granularity, count(*) FILTER (WHERE h = 24) AS whole_days, CAST(24 * count(*) FILTER (WHERE h = 24) AS BIGINT) AS hours
FROM (SELECT date_trunc('day', make_timestamp(ts_ms * 1000)) AS day, count(DISTINCT ts_ms // 3600000) AS h FROM log WHERE c_country IN ('GB', 'US') GROUP BY 1)""")  # fmt: skip
def m8(spark, d):
    log = access_log(spark, d).filter(F.col("c_country").isin("GB", "US"))
    found = merge.covering_windows(as_rows(spark, _month(("daily",))), with_windows(log, ["hourly"]).select(*WINDOW).distinct())
    days = found.withColumn("day", F.floor(F.unix_seconds("window_start") / 86_400))
    return days.agg(F.lit("daily").alias("granularity"), F.count_distinct("day").alias("whole_days"), F.count(F.lit(1)).alias("hours"))


@query("m10_freshness", "SELECT granularity, max(window_start + CASE granularity WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 1 HOUR END + INTERVAL 15 MINUTE) AS computed_at, min(window_start) AS \"from\", max(window_start + CASE granularity WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 1 HOUR END) AS until, count(DISTINCT window_start) AS windows FROM win GROUP BY 1", _WIN_LOG)
def m10(spark, d):
    seen = with_windows(access_log(spark, d)).select(*WINDOW).distinct()
    ledger = _ledger(spark, _month()).join(seen, WINDOW, "left_semi")
    fresh = merge.freshness(ledger)
    return fresh.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("computed_at", "from", "until")})


@query("t5_pending_windows", "SELECT granularity, window_start FROM (SELECT 'hourly' AS granularity, unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 HOUR)) AS window_start) r WHERE window_start NOT IN (SELECT window_start FROM win WHERE granularity = 'hourly' AND event_part)", _WIN_LOG.replace("SELECT *, 'hourly'", "SELECT *, cs_method = 'POST' AS event_part, 'hourly'").replace("UNION ALL SELECT *, 'daily'", "UNION ALL SELECT *, cs_method = 'POST', 'daily'"))
def t5(spark, d):
    done = with_windows(access_log(spark, d).filter("cs_method = 'POST'"), ["hourly"]).select(*WINDOW).distinct()
    return _naive(pending(as_rows(spark, _month(("hourly",))), done))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-summaries-")
    return f"{base.rstrip('/')}/summaries-{uuid.uuid4().hex}"


_STATES = "SELECT granularity, window_start, CASE WHEN n > 0 THEN 'rows' ELSE 'empty' END AS state, n FROM (SELECT 'daily' AS granularity, r.w AS window_start, count(DISTINCT l.path) AS n FROM (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS w) r LEFT JOIN (SELECT date_trunc('day', make_timestamp(ts_ms * 1000)) AS w, path FROM log WHERE {v} AND {p}) l USING (w) GROUP BY r.w)".replace("{v}", VIEW).replace("{p}", PEOPLE)


@query("s6_s7_stored_windows", _STATES)
def s6(spark, d):
    """Windows stored twice (the second time at a limit of all) and read back by state."""
    store = SummaryStore(spark, _folder(spark))
    spans = _month(("daily",))
    for request in (Request(limit=1), ALL):
        store.write("pageviews", compute(access_log(spark, d), registry()["pageviews"], request, spans), spans, F.current_timestamp())
    return _naive(store.states("pageviews", as_rows(spark, spans)))


# -- calendars and reports -----------------------------------------------------------


def _periods(spark, d, zone):
    return calendar.periods(calendar.local_days(access_log(spark, d), zone), zone)


def _dated(rows: DataFrame) -> DataFrame:
    """Dates as text: the two engines hand them out as different types."""
    return rows.withColumns({c: F.col(c).cast("string") for c, kind in rows.dtypes if kind == "date"})


_CALENDAR = """days AS (SELECT DISTINCT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day FROM log), periods AS (
  SELECT DISTINCT 'day' AS unit, day AS starts_on, day + 1 AS ends_before FROM days
  UNION SELECT 'week', CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('week', day) AS DATE) + 7 FROM days
  UNION SELECT 'month', CAST(date_trunc('month', day) AS DATE), CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) FROM days
  UNION SELECT 'year', CAST(date_trunc('year', day) AS DATE), CAST(date_trunc('year', day) + INTERVAL 1 YEAR AS DATE) FROM days
)"""


@query("r1_calendar_utc", 'SELECT unit, CAST(starts_on AS STRING) AS starts_on, CAST(ends_before AS STRING) AS ends_before, CAST(starts_on AS TIMESTAMP) AS "from", CAST(ends_before AS TIMESTAMP) AS until FROM periods', f"{DUCK_LOG}, {_CALENDAR}")
def r1(spark, d):
    rows = _periods(spark, d, "UTC")
    return _dated(rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from", "until")}))


def _zoned(hours: int) -> str:
    """Periods of a zone that is so many hours ahead of UTC at all bounds of the log's days, weeks, months and years."""
    local = _CALENDAR.replace("CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day", f"CAST(make_timestamp((ts_ms + {hours} * 3600000) * 1000) AS DATE) AS day")
    return f"{DUCK_LOG}, {local}"


def _zoned_sql(hours: int) -> str:
    at = lambda c: f"epoch_ms(CAST({c} AS TIMESTAMP)) - {hours} * 3600000"
    return f"SELECT unit, CAST(starts_on AS STRING) AS starts_on, CAST(ends_before AS STRING) AS ends_before, {at('starts_on')} AS from_ms, {at('ends_before')} AS until_ms FROM periods"


def _in_zone(spark, d, zone):
    rows = _periods(spark, d, zone)
    return _dated(rows.select("unit", "starts_on", "ends_before", F.unix_millis("from").alias("from_ms"), F.unix_millis("until").alias("until_ms")))


query("r1_calendar_london", _zoned_sql(0), _zoned(0))(lambda spark, d: _in_zone(spark, d, "Europe/London"))
query("r1_calendar_sydney", _zoned_sql(11), _zoned(11))(lambda spark, d: _in_zone(spark, d, "Australia/Sydney"))
query("r1_calendar_new_york", _zoned_sql(-5), _zoned(-5))(lambda spark, d: _in_zone(spark, d, "America/New_York"))


@query("r4_closing_periods", "SELECT CAST(d.starts_on AS STRING) AS day, p.unit, CAST(p.starts_on AS STRING) AS starts_on, CAST(p.ends_before AS STRING) AS ends_before FROM periods p JOIN periods d ON d.unit = 'day' AND d.ends_before = p.ends_before", f"{DUCK_LOG}, {_CALENDAR}")
def r4(spark, d):
    return _dated(calendar.closing_with_days(_periods(spark, d, "UTC")).select("day", "unit", "starts_on", "ends_before"))


@query("r3_previous_periods", "SELECT unit, CAST(starts_on AS STRING) AS starts_on, CAST(CAST(CASE unit WHEN 'day' THEN starts_on - INTERVAL 1 DAY WHEN 'week' THEN starts_on - INTERVAL 7 DAY WHEN 'month' THEN starts_on - INTERVAL 1 MONTH ELSE starts_on - INTERVAL 1 YEAR END AS DATE) AS STRING) AS previous_starts_on FROM periods", f"{DUCK_LOG}, {_CALENDAR}")
def r3(spark, d):
    return _dated(calendar.previous(_periods(spark, d, "UTC"), "UTC").select("unit", "starts_on", "previous_starts_on"))


@query("r6_source_windows", "SELECT unit, CAST(starts_on AS STRING) AS starts_on, 'daily' AS granularity, CAST(ends_before - starts_on AS BIGINT) AS windows FROM periods", f"{DUCK_LOG}, {_CALENDAR}")
def r6(spark, d):
    rows = calendar.source_windows(_periods(spark, d, "UTC"))
    return _dated(rows.groupBy("unit", "starts_on", "granularity").agg(F.count(F.lit(1)).alias("windows")))


_WEEK = (1_704_672_000_000, 1_705_276_800_000)  # 2024-01-08 to 2024-01-15
_LAST_WEEK = (1_704_067_200_000, 1_704_672_000_000)
_IN_WEEK = "ts_ms >= {0} AND ts_ms < {1}"


@query("r7_period_query", _views(f"{PEOPLE} AND {_IN_WEEK.format(*_WEEK)}"))
def r7(spark, d):
    return reports.period_answer(access_log(spark, d), registry()["pageviews"], Request(), *_WEEK)


@query("r9_summarised_section", _top("sc_status AS status, count(*) AS responses", "log", f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon') AND {_IN_WEEK.format(*_WEEK)}", "1", "responses DESC, status", None))
def r9(spark, d):
    question = registry()["status-codes"]
    stored = compute(access_log(spark, d), question, ALL, _month(("daily",))).withColumn("version", F.lit(1))
    week = [s for s in _month(("daily",)) if _WEEK[0] <= s.start < _WEEK[1]]
    return reports.summarised(stored, as_rows(spark, week), question)


_SECTIONS = [("pageviews", "ranked", "summaries"), ("status-codes", "additive", "summaries"), ("web-vitals", "percentile", "summaries"), ("visitors", "visitor-count", "summaries"), ("cache-hit-ratio", "additive", "period-query"), ("referrers", "missing", "summaries"), ("browsers", "ranked", "summaries")]


@query("r11_section_accuracy", """s(section, rule, calculation) AS (VALUES {rows}), found AS (
  SELECT DISTINCT section, rule, calculation, make_timestamp((ts_ms - ts_ms % 86400000) * 1000) AS f FROM log, s
  WHERE ts_ms >= 1704672000000 AND ts_ms < 1705276800000 AND calculation = 'summaries' AND rule <> 'missing' AND NOT (section = 'browsers' AND day = '10')
), n AS (SELECT section, count(*) AS n, max(f) - min(f) = INTERVAL 1 DAY * (count(*) - 1) AND count(*) = 7 AS whole FROM found GROUP BY 1)
SELECT s.section, CASE WHEN rule = 'missing' THEN 'unavailable' WHEN calculation = 'period-query' THEN 'exact' WHEN NOT coalesce(whole, false) THEN 'unavailable'
  WHEN rule = 'additive' THEN 'exact' WHEN rule = 'ranked' THEN 'approximate' ELSE 'unavailable' END AS accuracy,
  CASE WHEN rule = 'missing' THEN 'missing-rollup' WHEN calculation = 'period-query' THEN NULL WHEN NOT coalesce(whole, false) THEN 'incomplete-source'
  WHEN rule = 'visitor-count' THEN 'visitor-counts-do-not-compose' WHEN rule = 'percentile' THEN 'percentiles-do-not-compose' END AS reason,
  CAST(coalesce(n, 0) AS BIGINT) AS summaries
FROM s LEFT JOIN n USING (section)""".replace("{rows}", ", ".join(str(x) for x in _SECTIONS)).replace("s(section", "--cte s(section", 1))  # fmt: skip
def r11(spark, d):
    sections = spark.createDataFrame(_SECTIONS, "section string, rule string, calculation string")
    bounds = {"period_from": F.timestamp_millis(F.lit(_WEEK[0])), "period_until": F.timestamp_millis(F.lit(_WEEK[1]))}
    rows = access_log(spark, d).filter(F.col("ts_ms").between(_WEEK[0], _WEEK[1] - 1))
    days = with_windows(rows, ["daily"]).select(F.col("window_start").alias("from")).distinct().withColumn("until", F.col("from") + F.expr("INTERVAL 1 DAY"))
    windows = sections.filter("rule <> 'missing' AND calculation = 'summaries'").join(days).filter(~((F.col("section") == "browsers") & (F.dayofmonth("from") == 10)))
    whole = sections.filter("calculation = 'period-query'").select("section", F.timestamp_millis(F.lit(_WEEK[0])).alias("from"), F.timestamp_millis(F.lit(_WEEK[1])).alias("until"))
    judged = reports.judged_sections(windows.select("section", "from", "until").unionByName(whole), sections.withColumns(bounds))
    return judged.select("section", "accuracy", "reason", "summaries")


@query("r13_document_coverage", f"SELECT min(make_timestamp((ts_ms - ts_ms % 86400000) * 1000)) AS \"from\", max(make_timestamp((ts_ms - ts_ms % 86400000 + 86400000) * 1000)) AS until, count(DISTINCT ts_ms // 86400000) = 7 AS complete, 2 AS sections FROM log WHERE {_IN_WEEK.format(*_WEEK)}")
def r13(spark, d):
    """Coverage of a document of two sections, one from daily windows and one from a period query."""
    start, end = (F.timestamp_millis(F.lit(x)) for x in _WEEK)
    sections = spark.createDataFrame([("pageviews", "ranked", "summaries"), ("cache-hit-ratio", "additive", "period-query")], "section string, rule string, calculation string")
    rows = access_log(spark, d).filter(F.col("ts_ms").between(_WEEK[0], _WEEK[1] - 1))
    days = with_windows(rows, ["daily"]).select(F.lit("pageviews").alias("section"), F.col("window_start").alias("from")).distinct()
    windows = days.withColumn("until", F.col("from") + F.expr("INTERVAL 1 DAY")).unionByName(sections.filter("calculation = 'period-query'").select("section", start.alias("from"), end.alias("until")))
    found = reports.coverage(reports.judged_sections(windows, sections.withColumn("period_from", start).withColumn("period_until", end)))
    return found.withColumns({"from": F.col("from").cast("timestamp_ntz"), "until": F.col("until").cast("timestamp_ntz"), "sections": F.col("sections").cast("int")})


_VALUES = {
    "pageviews": f"SELECT to_json(list(x ORDER BY x.path NULLS FIRST, x.views)) AS value FROM (SELECT struct_pack(path := path, views := views) AS x FROM ({_views(f'{PEOPLE} AND {_IN_WEEK.format(*_WEEK)}')}))",
    "status-codes": f"SELECT to_json(list(x ORDER BY x.status)) FROM (SELECT struct_pack(status := status, responses := responses) AS x FROM (SELECT sc_status AS status, count(*) AS responses FROM log WHERE {PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon') AND {_IN_WEEK.format(*_WEEK)} GROUP BY 1 ORDER BY responses DESC, status LIMIT 20))",
    "cache-hit-ratio": f"SELECT to_json(list(struct_pack(hits := hits, misses := misses, hit_percent := hit_percent))) FROM (SELECT {_RATIO} FROM log WHERE {PEOPLE} AND {_IN_WEEK.format(*_WEEK)})",
}


@query("r14_report_values", " UNION ALL ".join(f"SELECT '{n}' AS section, 'exact' AS accuracy, v.value FROM ({x}) v(value)" for n, x in _VALUES.items()))
def r14_values(spark, d):
    return r14(spark, d).select("section", "accuracy", "value")


@query("r14_report_document")
def r14(spark, d):
    log = access_log(spark, d)
    names = ["pageviews", "status-codes", "cache-hit-ratio"]
    values = {n: reports.period_answer(log, registry()[n], Request(), *_WEEK) for n in names}
    sections = spark.createDataFrame([(n, reports.rule(registry()[n]), "period-query") for n in names], "section string, rule string, calculation string")
    start, end = (F.timestamp_millis(F.lit(x)) for x in _WEEK)
    whole = sections.select("section", start.alias("from"), end.alias("until"))
    return reports.document(reports.judged_sections(whole, sections.withColumn("period_from", start).withColumn("period_until", end)), values)


# -- comparisons ---------------------------------------------------------------------


def _two_weeks(spark, d, name, request):
    log = access_log(spark, d)
    return tuple(registry()[name].answer(log, replace(request, span=TimeRange(a, b - 1))) for a, b in (_WEEK, _LAST_WEEK))


def _compared_sql(key: str, measure: str, body: str, reason: str) -> str:
    return f"""--cte cur AS ({body.replace("SPAN", _IN_WEEK.format(*_WEEK))}), prev AS ({body.replace("SPAN", _IN_WEEK.format(*_LAST_WEEK))})
SELECT coalesce(c.{key}, p.{key}) AS {key}, CAST(c.{measure} AS DOUBLE) AS current, CAST(p.{measure} AS DOUBLE) AS previous,
  CAST(c.{measure} - p.{measure} AS DOUBLE) AS difference, round(100.0 * (c.{measure} - p.{measure}) / p.{measure}, 6) AS change,
  CASE WHEN c.{measure} > p.{measure} THEN 'increase' WHEN c.{measure} < p.{measure} THEN 'decrease' WHEN c.{measure} = p.{measure} THEN 'unchanged' END AS trend,
  CASE WHEN c.{measure} IS NULL OR p.{measure} IS NULL THEN '{reason}' END AS reason
FROM cur c FULL JOIN prev p ON c.{key} = p.{key}"""


_PATHS = f"SELECT path, count(*) AS views FROM log WHERE {VIEW} AND {PEOPLE} AND SPAN GROUP BY 1 ORDER BY views DESC, path LIMIT 3"


@query("c4_compare_pageviews", _compared_sql("path", "views", _PATHS, "ranked-row-absent"))
def c4(spark, d):
    rows = compare.compared(*_two_weeks(spark, d, "pageviews", Request(limit=3)), compare.definitions()["pageviews", "rows"])
    return rows.select("path", "current", "previous", "difference", F.round("change", 6).alias("change"), "trend", "reason")


_STATUSES = f"SELECT sc_status AS status, count(*) AS responses FROM log WHERE {PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon') AND SPAN GROUP BY 1"


@query("c6_compare_statuses", _compared_sql("status", "responses", _STATUSES, "ranked-row-absent"))
def c6(spark, d):
    rows = compare.compared(*_two_weeks(spark, d, "status-codes", ALL), compare.definitions()["status-codes", "rows"])
    return rows.select("status", "current", "previous", "difference", F.round("change", 6).alias("change"), "trend", "reason")


_RATIOS = f"SELECT {_RATIO} FROM log WHERE {PEOPLE} AND SPAN"
_EACH_METRIC = """m AS (SELECT metric, unit, preference, ratio, cv, pv, cv - pv AS dv FROM (
  SELECT 'hits' AS metric, 'requests' AS unit, 'neutral' AS preference, false AS ratio, CAST(c.hits AS DOUBLE) AS cv, CAST(p.hits AS DOUBLE) AS pv FROM cur c, prev p
  UNION ALL SELECT 'misses', 'requests', 'neutral', false, c.misses, p.misses FROM cur c, prev p
  UNION ALL SELECT 'hit_percent', 'percent', 'higher-is-better', true, c.hit_percent, p.hit_percent FROM cur c, prev p))"""


@query("c5_compare_hit_ratio", f"""--cte cur AS ({_RATIOS.replace("SPAN", _IN_WEEK.format(*_WEEK))}), prev AS ({_RATIOS.replace("SPAN", _IN_WEEK.format(*_LAST_WEEK))}), {_EACH_METRIC}
SELECT metric, unit, cv AS current, pv AS previous, round(dv, 6) AS difference, round(CASE WHEN ratio THEN dv WHEN pv <> 0 THEN 100 * dv / abs(pv) END, 6) AS change,
  CASE WHEN ratio THEN 'percentage-points' ELSE 'relative-percent' END AS change_type, CASE WHEN dv > 0 THEN 'increase' WHEN dv < 0 THEN 'decrease' ELSE 'unchanged' END AS trend,
  CASE WHEN dv = 0 THEN 'unchanged' WHEN preference = 'neutral' THEN 'unrated' WHEN dv > 0 THEN 'improvement' ELSE 'regression' END AS assessment FROM m""")  # fmt: skip
def c5(spark, d):
    rows = compare.compared(*_two_weeks(spark, d, "cache-hit-ratio", ALL), compare.definitions()["cache-hit-ratio", "rows"])
    return rows.select("metric", "unit", "current", "previous", F.round("difference", 6).alias("difference"), F.round("change", 6).alias("change"), "change_type", "trend", "assessment")


@query("c7_compare_vitals")
def c7(spark, d):
    return compare.compared(*_two_weeks(spark, d, "web-vitals", ALL), compare.definitions()["web-vitals", "rows"])


_COUNTED = f"SELECT {_TERM} AS term, {_SEARCHES.format(codes=chr(39) + '302' + chr(39))} FROM log WHERE {_SEARCHED} AND SPAN GROUP BY 1"
_TEXT = "'{m} ' || CAST(c.{m} AS BIGINT) || ' searches (' || CASE WHEN p.{m} IS NULL THEN 'comparison unavailable' WHEN p.{m} = 0 THEN 'change unavailable from zero baseline' ELSE CASE WHEN r_{m} > 0 THEN '+' ELSE '' END || CASE WHEN r_{m} = floor(r_{m}) THEN CAST(CAST(r_{m} AS BIGINT) AS STRING) ELSE CAST(CAST(r_{m} AS DECIMAL(18, 1)) AS STRING) END || '%' END || ')'"
_ROUNDED = "floor(1000.0 * (c.{m} - p.{m}) / nullif(p.{m}, 0) + 0.5) / 10 AS r_{m}"


@query("c10_digest", f"""--cte cur AS ({_COUNTED.replace("SPAN", _IN_WEEK.format(*_WEEK))}), prev AS ({_COUNTED.replace("SPAN", _IN_WEEK.format(*_LAST_WEEK))}),
r AS (SELECT c, p, {_ROUNDED.format(m="searches")}, {_ROUNDED.format(m="redirected")} FROM cur c LEFT JOIN prev p ON c.term = p.term),
lines AS (SELECT row_number() OVER (ORDER BY c.searches DESC, c.term) AS place, 'term=' || c.term || ': ' || {_TEXT.format(m="searches")} || ', ' || {_TEXT.format(m="redirected")} AS line, count(*) OVER () AS n FROM r)
SELECT CAST(place AS INTEGER) AS place, line, greatest(n - 3, 0) AS omitted FROM lines WHERE place <= 3""")  # fmt: skip
def c10(spark, d):
    definition = compare.definitions()["searches", "rows"]
    rows = compare.compared(*_two_weeks(spark, d, "searches", ALL), definition)
    return compare.digest_rows(rows, ["term"], definition, 3)


@query("c8_compare_visitors", f"""--cte cur AS (SELECT count(DISTINCT c_ip || '|' || cs_user_agent) AS n FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-' AND {_IN_WEEK.format(*_WEEK)}),
prev AS (SELECT count(DISTINCT c_ip || '|' || cs_user_agent) AS n FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-' AND {_IN_WEEK.format(*_LAST_WEEK)})
SELECT 'distinct' AS metric, CAST(cur.n AS DOUBLE) AS current, CAST(prev.n AS DOUBLE) AS previous, round(100.0 * (cur.n - prev.n) / prev.n, 6) AS change FROM cur, prev""")  # fmt: skip
def c8(spark, d):
    log, sides = access_log(spark, d), []
    for start, end in (_WEEK, _LAST_WEEK):
        period = spark.createDataFrame([(salt(SECRET, "week", "UTC", "monday", str(start)),)], "salt string")
        rows = visitors(log, Request(span=TimeRange(start, end - 1)), period)
        sides.append(rows.withColumnRenamed("distinct_visitors", "distinct"))
    out = compare.compared(*sides, compare.definitions()["pageviews", "visitor-count"])
    return out.select("metric", "current", "previous", F.round("change", 6).alias("change"))


@query("c11_manifest", """SELECT CAST(d.starts_on AS STRING) AS day, p.unit, 'UTC/' || p.unit || CASE p.unit WHEN 'week' THEN '/week-starts-monday' ELSE '' END || '/' || CAST(p.starts_on AS STRING) AS current_key,
  'UTC/' || p.unit || CASE p.unit WHEN 'week' THEN '/week-starts-monday' ELSE '' END || '/' || CAST(CAST(CASE p.unit WHEN 'day' THEN p.starts_on - INTERVAL 1 DAY WHEN 'week' THEN p.starts_on - INTERVAL 7 DAY
  WHEN 'month' THEN p.starts_on - INTERVAL 1 MONTH ELSE p.starts_on - INTERVAL 1 YEAR END AS DATE) AS STRING) AS previous_key
FROM periods p JOIN periods d ON d.unit = 'day' AND d.ends_before = p.ends_before""", f"{DUCK_LOG}, {_CALENDAR}")  # fmt: skip
def c11(spark, d):
    rows = reports.manifest(calendar.closing_with_days(_periods(spark, d, "UTC")), "UTC")
    return _dated(rows.select("day", "unit", "current_key", "previous_key"))


def _scanned(spark, d, write, read):
    folder = f"{_folder(spark)}/log"
    write(access_log(spark, d), folder)
    rows = read(spark, folder)
    return rows.groupBy("distributionid", "year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("cs_user_agent")).alias("agent_chars"), F.count("c_ip").alias("with_ip"), F.max("ts_ms").alias("last_ms")
    )


_SCANNED = "SELECT distributionid, year, month, day, count(*) AS n, CAST(sum(length(cs_user_agent)) AS BIGINT) AS agent_chars, count(c_ip) AS with_ip, max(ts_ms) AS last_ms FROM log GROUP BY 1, 2, 3, 4"


@query("s1_s3_json_log", _SCANNED)
def s1(spark, d):
    from sitelens.sources import access_log as source

    def write(log, folder):
        named = [F.col(c).alias(f) for f, c in source.FIELDS.items()]
        log.select(*named, *source.PARTITIONS).write.partitionBy(*source.PARTITIONS[:-1]).option("compression", "gzip").json(folder)

    columns = source.chosen_columns()
    return _scanned(spark, d, write, lambda s, folder: source.read_json(s, folder, columns, "daily"))


@query("s2_parquet_log", _SCANNED)
def s2(spark, d):
    from sitelens.sources import access_log as source

    return _scanned(spark, d, lambda log, folder: source.curate(log, folder, "daily"), lambda s, folder: source.read_parquet(s, folder, granularity="daily", curated=True))


@query("t8_streamed_windows", _windowed("sc_status AS status, count(*) AS responses", f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon')", "sc_status", "responses", "status", "status, responses"), _WIN_LOG)
def t8(spark, d):
    """The log written in two parts and streamed; the stored windows are what a batch over all of it gives."""
    from sitelens.sources.access_log import PARTITIONS
    from sitelens.streaming.late import keep_current

    folder = _folder(spark)
    log = access_log(spark, d)
    for part in range(2):
        half = log.filter(F.pmod(F.hash("timestamp_ms", "cs_uri_stem"), F.lit(2)) == part).repartitionByRange(*PARTITIONS[1:4], "ts_ms")
        half.write.mode("append").partitionBy(*PARTITIONS[1:4]).parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 24).parquet(f"{folder}/log")
    store = SummaryStore(spark, f"{folder}/store")
    keep_current(stream, lambda: spark.read.schema(log.schema).parquet(f"{folder}/log"), registry()["status-codes"], Request(), store, f"{folder}/checkpoint").awaitTermination()
    return _naive(store.read("status-codes").drop("computed_at"))


# -- further operators, each held against SQL ------------------------------------------

_PERIOD_SALT = salt(SECRET, "month", "UTC", "monday", "2024-01-01")


@query("p14_visitor_digests", f"SELECT upper(sha256('{_PERIOD_SALT}' || '|' || c_ip || '|' || cs_user_agent)) AS visitor, count(*) AS views FROM log WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-' GROUP BY 1")
def p14(spark, d):
    rows = rows_for(access_log(spark, d), Request(), [is_page_view(), has_address()])
    return rows.groupBy(digest(F.lit(_PERIOD_SALT)).alias("visitor")).agg(F.count(F.lit(1)).alias("views"))


@query("w4_null_order", "SELECT country, count(*) AS responses FROM (SELECT nullif(c_country, 'DE') AS country FROM log) GROUP BY 1 ORDER BY responses DESC, country NULLS LAST LIMIT 3")
def w4(spark, d):
    rows = access_log(spark, d).select(F.nullif(F.col("c_country"), F.lit("DE")).alias("country"))
    return top(rows.groupBy("country").agg(F.count(F.lit(1)).alias("responses")), "responses", ["country"], 3)


@query("m6_refused_or_counted", f"SELECT CAST(greatest(count(*) FILTER (WHERE n = 0 AND h > lo AND h < hi), 0) AS BIGINT) AS holes, count(*) FILTER (WHERE n > 0) AS present, count(*) FILTER (WHERE n = 0 AND h > lo AND h < hi) > 0 AS refused FROM (SELECT h, n, min(CASE WHEN n > 0 THEN h END) OVER () AS lo, max(CASE WHEN n > 0 THEN h END) OVER () AS hi FROM (SELECT r.h, count(l.ts_ms) AS n FROM (SELECT unnest(range(19723, 19754)) AS h) r LEFT JOIN (SELECT ts_ms FROM log WHERE day NOT IN ('01', '05', '06', '31')) l ON l.ts_ms // 86400000 = r.h GROUP BY 1))")
def m6(spark, d):
    """Windows missing inside a range make an answer refused; those at its edges do not."""
    log = access_log(spark, d).filter(~F.col("day").isin("01", "05", "06", "31"))
    counts = merge.gaps(as_rows(spark, _month(("daily",))), with_windows(log, ["daily"]).select(*WINDOW).distinct())
    try:
        merge.require_no_holes(counts)
        refused = False
    except ValueError:
        refused = True
    return counts.select("holes", "present", F.lit(refused).alias("refused"))


@query("m9_adopted_windows", "SELECT CAST(day AS INTEGER) AS day, CAST(min(n) OVER () AS INTEGER) AS adopted_limit FROM (SELECT day, 20 + CAST(day AS INTEGER) % 3 AS n FROM log GROUP BY day)")
def m9(spark, d):
    """Days stored with limits of their own and no narrowing: all match, and the smallest limit holds."""
    days = access_log(spark, d).select(F.col("day").cast("int").alias("day")).distinct()
    ledger = days.withColumns({"include_bots": F.lit(False), "bot_agents": F.lit(None).cast("string"), "limit": 20 + F.col("day") % 3})
    return merge.adopted(ledger, {"include_bots": False}).select("day", "adopted_limit")


def _file(write, read):
    def run(spark, d):
        path = f"{_folder(spark)}/answer"
        answer = registry()["pageviews"].answer(access_log(spark, d))
        write(answer, path)
        return read(spark.read.schema(answer.schema), path)

    return run


query("s9_json_rows", _views(PEOPLE))(_file(write_json, lambda reader, path: reader.json(path)))
query("s9_csv_rows", _views(PEOPLE))(_file(write_csv, lambda reader, path: reader.option("header", True).option("quote", '"').option("escape", '"').csv(path)))


@query("s8_report_store", _views(f"{PEOPLE} AND {_IN_WEEK.format(*_WEEK)}"))
def s8(spark, d):
    """A report stored by its key, read back, and its value parsed again."""
    store = ReportStore(spark, f"{_folder(spark)}/reports")
    key = {"zone": F.lit("UTC"), "unit": F.lit("week"), "week_start": F.lit("monday"), "starts_on": F.lit("2024-01-08")}
    for _ in range(2):  # writing again replaces
        store.write(r14(spark, d).withColumns(key))
    value = store.read(unit="week", starts_on="2024-01-08").filter("section = 'pageviews'")
    rows = value.select(F.explode(F.from_json("value", "array<struct<path: string, views: bigint>>")).alias("r"))
    return rows.select("r.path", "r.views")


@query("j5_section_pairs", "--cte s AS (SELECT sc_status AS question, day, row_number() OVER (PARTITION BY sc_status, day < '16' ORDER BY day) AS nth FROM (SELECT DISTINCT sc_status, day FROM log)), c AS (SELECT * FROM s WHERE day >= '16'), p AS (SELECT * FROM s WHERE day < '16') SELECT coalesce(c.question, p.question) AS question, CAST(coalesce(c.nth, p.nth) AS INTEGER) AS nth, c.day AS current_at, p.day AS previous_at FROM c FULL JOIN p ON c.question = p.question AND c.nth = p.nth")
def j5(spark, d):
    """Days on which a status occurred, as sections of two halves of the month."""
    sections = access_log(spark, d).select(F.col("sc_status").alias("question"), F.col("day").alias("at")).distinct()
    return compare.paired_sections(sections.filter("at >= '16'"), sections.filter("at < '16'"))


@query("c2_c9_comparability", """--cte s AS (SELECT sc_status AS question, day < '16' AS old, count(*) % 7 <> 0 AS complete, CASE count(*) % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'approximate' ELSE 'exact' END AS accuracy,
  CASE WHEN count(*) % 3 = 0 THEN 'a' ELSE 'b' END AS value_type FROM log GROUP BY 1, 2), c AS (SELECT * FROM s WHERE NOT old), p AS (SELECT * FROM s WHERE old),
r AS (SELECT coalesce(c.question, p.question) AS question, CASE WHEN c.question IS NULL OR p.question IS NULL THEN 'section-absent' WHEN NOT (c.complete AND p.complete) THEN 'incomplete-source'
  WHEN c.accuracy = 'unavailable' OR p.accuracy = 'unavailable' THEN 'section-unavailable' WHEN c.value_type <> p.value_type THEN 'value-type-mismatch' WHEN c.question = '404' THEN 'unsupported-question'
  WHEN c.question = '302' THEN 'columns-mismatch' END AS reason, c.accuracy = 'approximate' OR p.accuracy = 'approximate' AS close FROM c FULL JOIN p ON c.question = p.question)
SELECT question, reason, CASE WHEN reason IS NULL THEN CASE WHEN close THEN 'approximate' ELSE 'exact' END END AS accuracy FROM r""")  # fmt: skip
def c2(spark, d):
    """Sections by status, whose counts decide what they lack."""
    n = F.count(F.lit(1))
    made = access_log(spark, d).groupBy(F.col("sc_status").alias("question"), (F.col("day") < "16").alias("old")).agg(
        (n % 7 != 0).alias("complete"), F.when(n % 5 == 0, "unavailable").when(n % 5 == 1, "approximate").otherwise("exact").alias("accuracy"), F.when(n % 3 == 0, "a").otherwise("b").alias("value_type"),
    )
    made = made.withColumns({"at": F.lit(1), "question_text": F.col("question"), "columns": F.when(F.col("question") == "302", F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("responses"))), "defined": F.col("question") != "404", "metrics": F.array(F.lit("responses"))})
    pairs = compare.paired_sections(made.filter("NOT old"), made.filter("old")).drop("nth")
    side = lambda name, old: made.filter(F.col("old") == old).select("question", *[F.col(c).alias(f"{name}_{c}") for c in made.columns if c not in ("question", "old", "at")])
    rows = pairs.join(side("c", False), "question", "left").join(side("p", True), "question", "left")
    return compare.comparability(rows).select("question", "reason", "accuracy")


# -- stored answers and the matrix -------------------------------------------------------

_STATUS_VIEWS = f"{PEOPLE} AND NOT starts_with(cs_uri_stem, '/_beacon')"
_FIRST_DAY, _LAST_DAY = "(SELECT min(ts_ms) // 86400000 * 86400000 FROM log)", "(SELECT max(ts_ms) // 86400000 * 86400000 FROM log)"


def _kept_statuses(spark, log: DataFrame, request: Request, lost_days: tuple[int, ...], lost_hours: tuple[int, ...]) -> SummaryStore:
    """Status codes of every hour and day of a log, but for some days' daily windows and some days' hourly ones (by place in the log)."""
    question, first, day = registry()["status-codes"], _extent(log).start, 24 * HOUR
    lost = lambda w: (w.start - first) // day in (lost_days if w.granularity == "daily" else lost_hours)
    spans = [w for w in _windows(log) if not lost(w)]
    store = SummaryStore(spark, _folder(spark))
    store.write("statuses", compute(log, question, request, spans), spans, F.current_timestamp(), identity(question, request))
    return store


@query("m_stored_answer", _top("sc_status AS status, count(*) AS responses", "log", f"{_STATUS_VIEWS} AND ts_ms BETWEEN {_FIRST_DAY} + 5400000 AND {_LAST_DAY} + 80399999", "1", "responses DESC, status", None))
def m_stored(spark, d):
    """All of a log but its first 90 and last 100 minutes: a day of hours, a day and both edges out of the log, the rest out of stored days."""
    log = access_log(spark, d)
    store, span = _kept_statuses(spark, log, ALL, (2, 4), (2,)), _extent(log)
    return answered(store, "statuses", registry()["status-codes"], TimeRange(span.start + 90 * 60_000, span.end - 100 * 60_000), ALL, log=log).rows


@query("m_stored_windows", _top("sc_status AS status, count(*) AS responses", "log", f"{_STATUS_VIEWS} AND c_country = 'GB' AND ts_ms BETWEEN {_FIRST_DAY} + 7200000 AND {_LAST_DAY} + 79199999", "1", "responses DESC, status", None))
def m_stored_windows(spark, d):
    """The same range out of whole stored windows alone, narrowed as these are."""
    log = access_log(spark, d)
    store, span = _kept_statuses(spark, log, Request(limit=None, countries=("GB",)), (4,), ()), _extent(log)
    return answered(store, "statuses", registry()["status-codes"], TimeRange(span.start + 90 * 60_000, span.end - 100 * 60_000), ALL).rows


_HITS_BY_WINDOW = f"SELECT granularity, window_start, '' AS key, {_HITS} AS first, {_MISSES} AS second FROM win WHERE {PEOPLE} GROUP BY granularity, window_start"
_MATRIX = {
    "pageviews": _windowed("path, count(*) AS views", f"{VIEW} AND {PEOPLE}", "path", "views", "path", "concat_ws('|', path) AS key, views AS first, 0 AS second", 3),
    "referrers": _windowed(f"{HOST} AS referrer, count(*) AS views", f"{VIEW} AND {PEOPLE} AND cs_referer <> '-' AND {HOST} <> x_host_header", "referrer", "views", "referrer", "referrer AS key, views AS first, 0 AS second", 3),
    "browsers": _windowed(f"{_BROWSER} AS browser, {_DEVICE} AS device, count(*) AS views", f"{VIEW} AND {PEOPLE}", "browser, device", "views", "browser, device", "browser || '|' || device AS key, views AS first, 0 AS second", 3),
    "status-codes": _windowed("sc_status AS status, count(*) AS responses", _STATUS_VIEWS, "status", "responses", "status", "status AS key, responses AS first, 0 AS second", 3),
    "cache-hit-ratio": _HITS_BY_WINDOW,
    "searches": _windowed(f"{_TERM} AS term, {_SEARCHES.format(codes=chr(39) + '302' + chr(39))}", _SEARCHED, "term", "searches", "term", "term AS key, searches AS first, redirected AS second", 3),
}


@query("t7_matrix", "SELECT name, granularity, window_start, key, CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, * FROM ({x})" for n, x in _MATRIX.items()) + ")", _WIN_LOG)
def t7(spark, d):
    """Six questions at two cadences in one scan of the log."""
    log = access_log(spark, d)
    scheduled = matrix([(n, registry()[n], ["hourly", "daily"], Request(limit=3, redirects=("302",))) for n in _MATRIX])
    rows = compute_matrix(log, scheduled, _windows(log))
    keys = F.concat_ws("|", "path", "referrer", "browser", "device", "status", "term")
    first, second = F.coalesce("views", "responses", "hits", "searches"), F.coalesce("misses", "redirected", F.lit(0))
    return _naive(rows.select("name", *WINDOW, keys.alias("key"), first.alias("first"), second.alias("second")))


# -- requests, spans and single steps -----------------------------------------------------


@query("s4_field_projection", "SELECT 'timestamp_ms,cs_uri_stem,sc_status' AS columns, sc_status, count(*) AS n, CAST(sum(length(cs_uri_stem)) AS BIGINT) AS chars FROM log GROUP BY 2")
def s4(spark, d):
    """A delivery of chosen fields without the viewer's address, written and read back."""
    from sitelens.sources import access_log as source

    columns = source.chosen_columns(["sc-status", "cs-uri-stem", "c-ip"], viewer_address=False)
    folder, names = f"{_folder(spark)}/log", {c: f for f, c in source.FIELDS.items()}
    access_log(spark, d).select(*[F.col(c).alias(names[c]) for c in columns], *source.PARTITIONS[:-1]).write.partitionBy(*source.PARTITIONS[:-1]).json(folder)
    rows = source.read_json(spark, folder, columns, "daily")
    return rows.groupBy("sc_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("cs_uri_stem")).alias("chars")).withColumn("columns", F.lit(",".join(columns)))


_NOON = datetime(2024, 1, 20, 12, 10, tzinfo=UTC)
_WAYS = {
    "relative": ({"last_": "2d"}, (1_705_579_800_000, 1_705_752_600_000)), "day": ({"day": "2024-01-11"}, (1_704_931_200_000, 1_705_017_600_000)),
    "explicit": ({"start": "2024-01-11T06:00", "until": "2024-01-12"}, (1_704_952_800_000, 1_705_017_600_000)),
}


@query("f5_f6_spans", " UNION ALL ".join(f"SELECT '{n}' AS way, count(*) AS n FROM log WHERE ts_ms BETWEEN {a} AND {b}" for n, (_, (a, b)) in _WAYS.items()))
def f5(spark, d):
    log = access_log(spark, d)
    parts = [pruned(log, asked_span(_NOON, **asked)).agg(F.lit(n).alias("way"), F.count(F.lit(1)).alias("n")) for n, (asked, _) in _WAYS.items()]
    return reduce(DataFrame.unionByName, parts)


query("f17_no_redirects", _top(f"{_TERM} AS term, count(*) AS searches, CAST(0 AS BIGINT) AS redirected", "log", _SEARCHED, "1", "searches DESC, term"))(ask("searches", Request(redirects=())))
query("f19_rendered_by_path", _views(f"{PEOPLE} AND {RENDERED.format(log='log').replace('/_beacon', '/blog/')}"))(ask("pageviews", Request(rendered_only="/blog/")))
query("u4_without_visitors", _views(PEOPLE))(lambda spark, d: registry()["pageviews"].without_visitors().answer(access_log(spark, d)))


def _salt_rows() -> str:
    """Salts of January 2024 as SQL values, by HMAC's own definition."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = (bytes(k ^ x for k in key) for x in (0x36, 0x5C))
    made = lambda day: sha256(outer + sha256(inner + f"visitors|1|day|{day}".encode()).digest()).hexdigest()
    return ", ".join(f"('{day}', '{made(day)}')" for day in (f"2024-01-{n:02}" for n in range(1, 32)))


@query("p16_daily_digests", f"""--cte s(day_text, salt) AS (VALUES {_salt_rows()}) SELECT day_text, upper(sha256(salt || '|' || c_ip || '|' || cs_user_agent)) AS visitor, count(*) AS views
FROM (SELECT *, CAST(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS STRING) AS day_text FROM log) JOIN s USING (day_text) WHERE {VIEW} AND {PEOPLE} AND c_ip <> '-' GROUP BY 1, 2""")  # fmt: skip
def p16(spark, d):
    log = access_log(spark, d)
    rows = rows_for(log, Request(), [is_page_view(), has_address()]).withColumn("day_text", calendar.local_date(F.col("ts_ms"), "UTC").cast("string"))
    rows = rows.join(_salts(log).withColumnRenamed("day", "day_text"), "day_text")
    return rows.groupBy("day_text", digest(F.col("salt")).alias("visitor")).agg(F.count(F.lit(1)).alias("views"))


_MERGES = {"status-codes": False, "web-vitals": True, "conversions-purchase": True, "cache-hit-ratio": False}


@query("m5_refused_merges", f"SELECT name, refused, (SELECT count(DISTINCT day) FROM log) AS windows FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {r})' for n, r in _MERGES.items())}) v(name, refused)")
def m5(spark, d):
    """Which questions' days combine."""
    log, told = access_log(spark, d), []
    days = with_windows(log, ["daily"]).select("window_start").distinct().count()
    spans = _windows(log, ("daily",))
    for name in _MERGES:
        question = conversion_on_event("purchase") if name.startswith("conversions") else registry()[name]
        try:
            merge.answer_from_windows(compute(log, question, ALL, spans), question, days)
            told.append((name, False, days))
        except ValueError:
            told.append((name, True, days))
    return spark.createDataFrame(told, "name string, refused boolean, windows long")


@query("m6_single_window", _views(f"{PEOPLE} AND ts_ms BETWEEN {_FIRST_DAY} AND {_FIRST_DAY} + 86399999", limit=3))
def m6_single(spark, d):
    """One stored day, cut to a shorter ranking than it keeps."""
    log, question = access_log(spark, d), registry()["pageviews"]
    store, day = SummaryStore(spark, _folder(spark)), _extent(log).start
    spans = [w for w in _windows(log, ("daily",)) if w.start == day]
    store.write("views", compute(log, question, ALL, spans), spans, F.current_timestamp(), identity(question, ALL))
    return answered(store, "views", question, TimeRange(day, day + 24 * HOUR - 1), Request(limit=3), {"limit"}).rows


@query("t2_t3_recent_windows", f"SELECT granularity, window_start, sc_status AS status, count(*) AS responses FROM win WHERE {_STATUS_VIEWS} AND (granularity = 'hourly' AND window_start IN (TIMESTAMP '2024-01-20 09:00:00', TIMESTAMP '2024-01-20 10:00:00') OR granularity = 'daily' AND window_start IN (TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-19')) GROUP BY 1, 2, 3", _WIN_LOG)
def t2(spark, d):
    """At ten past noon, 15 minutes being the time that rows may take: the two hours and days that closed last."""
    spans = [w for g in ("hourly", "daily") for w in recent(due(_NOON, 15), g)]
    return _naive(compute(access_log(spark, d), registry()["status-codes"], ALL, spans))


@query("r2_closed_periods", "SELECT unit, CAST(starts_on AS STRING) AS starts_on, CAST(ends_before AS STRING) AS ends_before FROM periods WHERE ends_before <= DATE '2024-01-20'", f"{DUCK_LOG}, {_CALENDAR}")
def r2(spark, d):
    rows = calendar.closed(_periods(spark, d, "UTC"), F.make_timestamp(F.lit(2024), F.lit(1), F.lit(20), F.lit(12), F.lit(0), F.lit(0), F.lit("UTC")))
    return _dated(calendar.require_closed(rows, F.lit("2024-01-20T00:00:00Z").cast("timestamp")).select("unit", "starts_on", "ends_before"))


@query("r5_selected_week", _views(f"{PEOPLE} AND ts_ms >= 1704585600000 AND ts_ms < 1705190400000"))
def r5(spark, d):
    """The week of a day, beginning on a Sunday."""
    row = calendar.selected_period(spark, "2024-01-10", "UTC", "sunday", week=True).select(F.unix_millis("from").alias("a"), F.unix_millis("until").alias("b")).first()
    return reports.period_answer(access_log(spark, d), registry()["pageviews"], Request(), row["a"], row["b"])


@query("r8_calculations", f"SELECT 'status-codes' AS section, 'summaries' AS calculation, count(*) AS counted FROM log WHERE {_STATUS_VIEWS} UNION ALL SELECT 'cache-hit-ratio', 'period-query', CAST({_HITS} AS BIGINT) FROM log WHERE {PEOPLE}")
def r8(spark, d):
    """Each section by the calculation that its question asks for: added-up days, or one query over the period."""
    log, parts = access_log(spark, d), []
    span, spans = _extent(log), _windows(log, ("daily",))
    for name in ("status-codes", "cache-hit-ratio"):
        question = registry()[name]
        how = reports.calculation(question)
        rows = reports.summarised(compute(log, question, ALL, spans), as_rows(spark, spans), question) if how == "summaries" else reports.period_answer(log, question, ALL, span.start, span.end + 1)
        parts.append(rows.agg(F.lit(name).alias("section"), F.lit(how).alias("calculation"), F.sum(question.added[0]).alias("counted")))
    return reduce(DataFrame.unionByName, parts)


_ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders"
_LENGTH = "CASE WHEN month(day) = 4 AND dayofweek(day) = 0 AND day(day) <= 7 THEN 23 WHEN month(day) = 10 AND dayofweek(day) = 0 AND day(day) >= 25 THEN 25 ELSE 24 END"


def _order_days(spark, d) -> DataFrame:
    """Days of the orders in New York, whose clocks changed on the first Sunday of April and the last of October in those years."""
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return calendar.periods(days, "America/New_York").filter("unit = 'day'")


@query("r1_days_of_23_and_25_hours", f"SELECT CAST(day AS STRING) AS starts_on, CAST({_LENGTH} AS BIGINT) AS hours FROM ({_ORDER_DAYS})")
def r1_lengths(spark, d):
    hours = (F.unix_millis("until") - F.unix_millis("from")) / HOUR
    return _dated(_order_days(spark, d).select("starts_on", hours.cast("long").alias("hours")))


@query("r6_hourly_windows", f"SELECT CAST(day AS STRING) AS starts_on, 'hourly' AS granularity, CAST({_LENGTH} AS BIGINT) AS windows FROM ({_ORDER_DAYS})")
def r6_hourly(spark, d):
    rows = calendar.source_windows(_order_days(spark, d))
    return _dated(rows.groupBy("starts_on", "granularity").agg(F.count(F.lit(1)).alias("windows")))


@query("r3_previous_in_zone", f"SELECT CAST(day AS STRING) AS starts_on, CAST(CAST(day - INTERVAL 1 DAY AS DATE) AS STRING) AS previous_starts_on FROM ({_ORDER_DAYS})")
def r3_zone(spark, d):
    return _dated(calendar.previous(_order_days(spark, d), "America/New_York").select("starts_on", "previous_starts_on"))


@query("c1_preceding_weeks", f"SELECT 'weeks' AS pair, true AS follows, (SELECT count(*) FROM log WHERE {_IN_WEEK.format(*_WEEK)}) AS current, (SELECT count(*) FROM log WHERE {_IN_WEEK.format(*_LAST_WEEK)}) AS previous UNION ALL SELECT 'same', false, (SELECT count(*) FROM log WHERE {_IN_WEEK.format(*_WEEK)}), (SELECT count(*) FROM log WHERE {_IN_WEEK.format(*_WEEK)})")
def c1(spark, d):
    """Two weeks compare only if one follows the other."""
    log, told = access_log(spark, d), []
    week = lambda text: calendar.selected_period(spark, text, "UTC", week=True)
    for pair, before in (("weeks", "2024-01-01"), ("same", "2024-01-08")):
        counts = [pruned(log, TimeRange(r["a"], r["b"] - 1)).count() for r in (week(t).select(F.unix_millis("from").alias("a"), F.unix_millis("until").alias("b")).first() for t in ("2024-01-08", before))]
        try:
            reports.require_preceding(week("2024-01-08"), week(before))
            told.append((pair, True, *counts))
        except ValueError:
            told.append((pair, False, *counts))
    return spark.createDataFrame(told, "pair string, follows boolean, current long, previous long")


@query("c3_metric_definitions", f"""--cte cur AS ({_STATUSES.replace("SPAN", _IN_WEEK.format(*_WEEK))}), prev AS ({_STATUSES.replace("SPAN", _IN_WEEK.format(*_LAST_WEEK))})
SELECT coalesce(c.status, p.status) AS status, 'responses' AS metric, 'answers' AS unit, 'lower-is-better' AS preference, CASE WHEN c.responses IS NULL OR p.responses IS NULL THEN NULL WHEN c.responses < p.responses THEN 'improvement'
  WHEN c.responses > p.responses THEN 'regression' ELSE 'unchanged' END AS assessment FROM cur c FULL JOIN prev p ON c.status = p.status""")  # fmt: skip
def c3(spark, d):
    """A caller's own definition (U5) in the place of the library's, and what the table of definitions says of it."""
    own = compare.Definition("status-codes", (compare.Metric("responses", "answers", preference="lower-is-better"),))
    known = compare.definitions([own])
    rows = compare.compared(*_two_weeks(spark, d, "status-codes", ALL), known["status-codes", "rows"]).drop("unit", "preference", "measure")
    table = compare.as_table(spark, list(known.values())).filter("question = 'status-codes'")
    return rows.join(table, "metric").select("status", "metric", "unit", "preference", "assessment")


_VITALS_IN = "SELECT event AS vital, quantile_disc(CAST(value AS DOUBLE), 0.75) AS p75, count(*) AS samples FROM ev WHERE {e} AND {p} AND {b} AND event IN ('lcp', 'cls', 'fcp', 'ttfb') AND {n} AND value NOT LIKE '-%' AND {{0}} GROUP BY 1".format(e=EVENT, p=PEOPLE, b=ON_BEACON, n=NUMBER)


@query("c7_units_by_vital", f"""--cte cur AS ({_VITALS_IN.format(_IN_WEEK.format(*_WEEK))}), prev AS ({_VITALS_IN.format(_IN_WEEK.format(*_LAST_WEEK))})
SELECT coalesce(c.vital, p.vital) AS vital, CASE coalesce(c.vital, p.vital) WHEN 'cls' THEN 'score' ELSE 'milliseconds' END AS unit, c.p75 AS current, p.p75 AS previous,
  CASE WHEN c.p75 IS NULL OR p.p75 IS NULL THEN NULL WHEN c.p75 < p.p75 THEN 'improvement' WHEN c.p75 > p.p75 THEN 'regression' ELSE 'unchanged' END AS assessment FROM cur c FULL JOIN prev p ON c.vital = p.vital""", _WITH_EVENTS)  # fmt: skip
def c7_units(spark, d):
    log, question = access_log(spark, d), Question("web-vitals-exact", web_vitals(exact=True), ranked=False)
    sides = [question.answer(log, Request(span=TimeRange(a, b - 1))) for a, b in (_WEEK, _LAST_WEEK)]
    return compare.compared(*sides, compare.definitions()["web-vitals", "rows"]).filter("metric = 'p75'").select("vital", "unit", "current", "previous", "assessment")
