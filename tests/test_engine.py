"""The analytics engine on hand-made logs, following the behaviours that matter most."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sitelens.functions import events
from sitelens.functions.text import decoded_path, is_number, measured, parameter, percent, referrer_host
from sitelens.functions.visitors import salt
from sitelens.operators import compare, merge
from sitelens.operators.questions import Question, Registry, conversion_on_event, conversion_on_path, registry, visitors
from sitelens.operators.rows import pruned
from sitelens.plans import calendar, reports
from sitelens.plans.request import Request, TimeRange, asked_span, between, countries, last, on_day
from sitelens.plans.windows import WINDOW, Span, as_rows, compute, coverage, due, matrix, overlapping, recent
from sitelens.sources import access_log as source
from sitelens.sources.stores import ReportStore, SummaryStore, write_csv, write_json

DAY = 1_787_443_200_000  # 2026-08-23
HOUR = 3_600_000
AGENT = "Mozilla/5.0%20(Macintosh)"
LOG = "ts_ms long, timestamp_ms string, c_ip string, cs_user_agent string, x_host_header string, c_country string, cs_method string, cs_uri_stem string, cs_uri_query string, sc_status string, sc_content_type string, cs_referer string, x_edge_result_type string, year string, month string, day string"


def row(at=0, ip="1.1.1.1", agent=AGENT, method="GET", stem="/", query="-", status="200", kind="text/html; charset=utf-8", host="www.example.com", country="GB", referer="-", result="Hit"):
    ms = DAY + at
    d = datetime.fromtimestamp(ms / 1000, UTC)
    return (ms, str(ms), ip, agent, host, country, method, stem, query, status, kind, referer, result, f"{d:%Y}", f"{d:%m}", f"{d:%d}")


def beacon(query, **more):
    return row(stem="/_beacon", query=query, status="204", kind="-", **more)


@pytest.fixture(scope="module")
def log(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LOG)


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_registered_queries_and_their_twins(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)  # each of them is run in test_queries.py or in tests/llm


def test_decoding(spark):
    rows = spark.createDataFrame([("/caf%25C3%25A9+x", "a=1&q=red%2520pear&zq=n"), ("/%zz", "q="), (None, None)], "s string, q string")
    out = rows.select(decoded_path(F.col("s")).alias("p"), parameter(F.col("q"), "q").alias("q")).collect()
    assert [tuple(r) for r in out] == [("/café x", "red pear"), (None, ""), (None, None)]
    hosts = spark.createDataFrame([("-",), ("https://a.example/b|c",), ("http://[bad",)], "r string").select(referrer_host(F.col("r"))).collect()
    assert hosts[0][0] is None and hosts[2][0] is None
    numbers = spark.createDataFrame([("1.5",), ("-2e3",), ("5d",), (" 5 ",), ("NaN",), ("",), (".5",)], "v string")
    assert [r[0] for r in numbers.select(measured(F.col("v"))).collect()] == [1.5, -2000.0, None, None, None, None, 0.5]
    assert numbers.filter(is_number(F.col("v"))).count() == 3
    assert spark.range(1).select(percent(F.lit(1), F.lit(3)), percent(F.lit(1), F.lit(0))).first()[:] == (33.3, None)


def test_pages_bots_and_ties(log):
    rows = log(row(stem="/b"), row(stem="/a"), row(stem="/a", status="404"), row(stem="/a", agent="x-CrawLer"), row(stem="/a", agent=None), row(stem="/a", method="POST"), row(stem="/c%25zz"))
    ask = registry()["pageviews"].answer
    assert got(ask(rows), "path", "views") == [("/a", 1), ("/b", 1), (None, 1)]
    assert got(ask(rows, Request(include_bots=True)), "path", "views")[0] == ("/a", 3)
    assert got(ask(rows, Request(bot_agents=("mozilla",))), "path", "views") == []
    assert got(ask(rows, Request(limit=1)), "path") == [("/a",)]
    with pytest.raises(ValueError):
        ask(rows, Request(bot_agents=(" ",)))


def test_narrowing(log):
    rows = log(row(stem="/x/1", country="DE"), row(stem="/x", host="b"), row(stem="/y"), row(stem="/%2578"))
    ask = registry()["pageviews"].answer
    assert sorted(got(ask(rows, Request(paths=("/x",))), "path", "views")) == [("/x", 2), ("/x/1", 1)]
    assert got(ask(rows, Request(host="b")), "path") == [("/x",)]
    assert got(ask(rows, Request(countries=countries(["de"]))), "path") == [("/x/1",)]
    assert got(ask(rows, Request(countries=())), "path") == []
    for bad in ({"countries": ("de",)}, {"rendered_only": "x"}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_events_of_both_versions(log):
    rows = log(
        beacon("v=1&e=error&p=%252Fp&m=a%252Cb%253Bc%2520%252B1"),
        beacon("v=2&b=purchase%252C%25252Fp%252C1999%253Berror%252C%25252Fq%252C%252C%252Ca%25252Cb%25253Bc%252520%25252B1"),
        beacon("-"), beacon("v=3"), beacon("v=2"),
    )
    out = events.with_events(rows).filter(events.is_event())
    assert sorted(got(out, *events.FIELDS)) == [("error", "/p", "", "", "a,b;c +1"), ("error", "/q", "", "", "a,b;c +1"), ("purchase", "/p", "1999", "", "")]
    assert events.with_events(rows).count() == 6


def test_floods_are_capped_by_hour_page_and_event(log):
    one = "v=2&b=route%252C%25252Fp"
    rows = [beacon(one, at=i) for i in range(75)] + [beacon(one, at=HOUR + i) for i in range(61)] + [beacon(one, ip="2.2.2.2"), beacon("v=2&b=click%252C%25252Fp")]
    out = registry()["beacon-events"].answer(log(*rows))
    assert sorted(got(out, "event", "page", "events")) == [("click", "/p", 1), ("route", "/p", 121)]


def test_totals(log):
    sale = "v=2&b=sale%252C%25252Fp%252C{}"
    rows = [beacon(sale.format(v)) for v in ("10", "-4", "abc", "")] + [beacon(sale.format(9), ip="3.3.3.3", at=i) for i in range(70)]
    rows += [beacon("v=2&b=lcp%252C%25252Fp%252C7"), beacon("v=2&b=other%252C%25252Fp%252Cx")]
    out = registry()["beacon-totals"].answer(log(*rows))
    assert got(out, "event", "events", "total") == [("sale", 63, 546.0), ("other", 1, 0.0)]


def test_vitals_and_errors(log):
    rows = [beacon(f"v=2&b=lcp%252C%25252Fp%252C{v}") for v in (1, 2, 3, 4, -1, "x")] + [beacon("v=1&e=rejection&p=%252Fp&m=oops")] * 2
    assert got(registry()["web-vitals"].answer(log(*rows)), "vital", "p75", "samples") == [("lcp", 3.0, 4)]
    assert got(registry()["javascript-errors"].answer(log(*rows)), "page", "message", "errors") == [("/p", "oops", 2)]


def test_searches(log):
    rows = log(row(stem="/s/", query="q=a%2520b", status="302"), row(stem="/s/", query="q=a%2520b"), row(stem="/t/", query="q=c"), row(stem="/s/", query="q="), row(query="-"))
    ask = registry()["searches"].answer
    assert got(ask(rows), "term", "searches", "redirected") == [("a b", 2, 1), ("c", 1, 0)]
    assert got(ask(rows, Request(paths=("/s/", "/t/"))), "term", "section") == [("a b", "/s/"), ("c", "/t/")]
    assert "section" not in ask(rows, Request(paths=("/s/",))).columns
    assert got(ask(rows, Request(redirects=())), "redirected") == [(0,), (0,)]


def test_cache_ratio_of_nothing_is_null(log):
    assert got(registry()["cache-hit-ratio"].answer(log(row(result="Error"))), "hits", "misses", "hit_percent") == [(0, 0, None)]
    assert got(registry()["cache-hit-ratio"].answer(log(row(agent=None))), "hits", "hit_percent") == [(None, None)]


def test_rendering(log):
    page = {"ip": "1.1.1.1"}
    rows = log(row(**page), row(stem="/a.css", kind="text/css", at=5, agent=AGENT, **page), row(ip="2.2.2.2"), row(ip="2.2.2.2", stem="/a.png", kind="image/png"), row(ip="3.3.3.3"), beacon("-", ip="3.3.3.3", host="other"))
    ask = registry()["pageviews"].answer
    assert got(ask(rows, Request(rendered_only=True, host="www.example.com")), "views") == [(2,)]
    late = log(row(ip="4.4.4.4"), row(ip="4.4.4.4", stem="/a.js", at=30 * HOUR))
    assert got(ask(late, Request(span=TimeRange(DAY, DAY + HOUR), rendered_only=True)), "views") == []
    windows = compute(log(row(ip="4.4.4.4"), row(ip="4.4.4.4", stem="/a.js", kind="-", at=2 * HOUR)), registry()["pageviews"], Request(rendered_only=True), [Span(DAY, "daily"), Span(DAY, "hourly"), Span(DAY + 2 * HOUR, "hourly")])
    assert got(windows, "granularity", "views") == [("daily", 1)]


def test_visitors(spark, log):
    rows = log(row(), row(at=1), row(at=30 * HOUR), row(ip="-"), row(ip=None), row(ip="2.2.2.2"), row(ip="2.2.2.2", stem="/x.css", kind="-"))
    salts = spark.createDataFrame([(d, salt("s", "day", d)) for d in ("2026-08-23", "2026-08-24")], "day string, salt string")
    assert got(visitors(rows, Request(), salts), "distinct_visitors") == [(3,)]
    assert got(visitors(rows, Request(), spark.createDataFrame([("x",)], "salt string")), "distinct_visitors") == [(2,)]
    assert got(visitors(rows, Request(rendered_only=True), salts, split=True), "distinct_visitors", "unrendered") == [(1, 2)]
    assert salt("s", "day", "a") != salt("t", "day", "a") != salt("t", "month", "a")
    assert got(visitors(log(row(agent="bot")), Request(), salts), "distinct_visitors") == [(0,)]


def test_conversions(log):
    bought = "v=2&b=buy%252C%25252Fp"
    rows = log(
        row(ip="1.1.1.1"), beacon(bought, ip="1.1.1.1"), row(ip="2.2.2.2"), beacon(bought, ip="3.3.3.3"), row(ip="4.4.4.4", stem="/_beacon"), row(ip="-"),
        row(ip="2.2.2.2", method="POST", stem="/do/buy", status="303", kind="-"), row(ip="1.1.1.1", method="POST", stem="/do/buy", status="400", kind="-"),
    )
    columns = ("converted", "visitors", "converted_percent")
    assert got(conversion_on_event("buy").answer(rows), *columns) == [(1, 2, 50.0)]
    assert got(conversion_on_event("buy").answer(rows, Request(paths=("/elsewhere",))), *columns) == [(0, 3, 0.0)]
    path = conversion_on_path("/do/buy", "post", ["303"])
    assert path.name == "conversions-do-buy" and got(path.answer(rows), *columns) == [(1, 2, 50.0)]
    assert got(conversion_on_path("/do/buy", by_device=True).answer(rows), "device", "converted", "visitors") == [("Desktop", 2, 2)]
    assert got(conversion_on_event("buy").answer(log(row(ip="-"))), *columns) == [(None, None, None)]


def test_registry_and_missing_address(log):
    own = Registry()
    with pytest.raises(ValueError):
        Question("Bad Name", None)
    own.add(Question("a-b", None))
    with pytest.raises(ValueError):
        own.add(Question("a-b", None))
    with pytest.raises(ValueError, match="address"):
        registry()["beacon-events"].answer(log(row()).drop("c_ip"))
    assert not registry()["pageviews"].without_visitors().counts_visitors


def test_spans():
    now = datetime(2026, 8, 23, 9, tzinfo=UTC)
    assert last("24h", now) == TimeRange(DAY - 15 * HOUR, DAY + 9 * HOUR)
    assert on_day("2026-08-23") == TimeRange(DAY, DAY + 24 * HOUR) == asked_span(now, day="2026-08-23")
    assert between("2026-08-23T01:00", "2026-08-23T02:00+00:00") == TimeRange(DAY + HOUR, DAY + 2 * HOUR)
    for bad in ({}, {"last_": "1d", "day": "2026-08-23"}, {"start": "2026-08-23"}, {"last_": "0d"}, {"start": "2026-08-24", "until": "2026-08-23"}):
        with pytest.raises(ValueError):
            asked_span(now, **bad)


def test_both_ends_of_a_span_count_and_directories_are_pruned(log):
    rows = log(row(at=-1), row(), row(at=24 * HOUR), row(at=24 * HOUR + 1))
    span = pruned(rows, on_day("2026-08-23"))
    assert span.count() == 2
    assert registry()["pageviews"].answer(rows, Request(span=TimeRange(DAY, DAY))).first()["views"] == 1


def test_windows():
    assert [s.start for s in recent(DAY + 90 * 60_000, "hourly")] == [DAY, DAY - HOUR]
    assert [s.start for s in overlapping(TimeRange(DAY + 1, DAY + 2 * HOUR), "hourly", DAY + 2 * HOUR)] == [DAY, DAY + HOUR]
    week = coverage(TimeRange(DAY + 22 * HOUR + 1, DAY + 50 * HOUR))
    assert week == [Span(DAY + 23 * HOUR, "hourly"), Span(DAY + 24 * HOUR, "daily"), Span(DAY + 48 * HOUR, "hourly"), Span(DAY + 49 * HOUR, "hourly")]
    assert coverage(TimeRange(DAY + 1, DAY + HOUR)) == []
    q = registry()["pageviews"]
    assert len(matrix([("a", q, ["hourly", "daily"], Request()), ("b", q, ["daily"], Request(limit=5))])) == 3
    with pytest.raises(ValueError):
        matrix([("a", q, ["daily"], Request()), ("a", q, ["daily"], Request())])
    assert due(datetime(2026, 8, 23, 1, 15, tzinfo=UTC)) == DAY + HOUR
    with pytest.raises(ValueError):
        due(datetime(2026, 8, 23, tzinfo=UTC), 60)


def test_a_window_ends_before_its_end(log):
    rows = log(row(), row(at=HOUR - 1), row(at=HOUR))
    out = compute(rows, registry()["pageviews"], Request(), [Span(DAY, "hourly")])
    assert got(out, "views") == [(2,)]


def test_merging(spark):
    q = registry()["searches"]
    rows = spark.createDataFrame([("hourly", 1, "a", "2", "1"), ("hourly", 2, "a", "3", "x"), ("hourly", 2, None, "1", None), ("hourly", 1, None, "1", "0")], "granularity string, window_start int, term string, searches string, redirected string")
    assert got(merge.answer_from_windows(rows, q, 2), "term", "searches", "redirected") == [("a", 5, 1), (None, 2, 0)]
    assert got(merge.answer_from_windows(rows, q, 2, 1), "term") == [("a",)]
    ratio = spark.createDataFrame([(1, 1), (2, None)], "hits int, misses int").withColumn("hit_percent", F.lit(9.0))
    assert got(merge.added_up(ratio, registry()["cache-hit-ratio"]), "hits", "misses", "hit_percent") == [(3, 1, 75.0)]
    with pytest.raises(ValueError):
        merge.answer_from_windows(rows, registry()["web-vitals"], 2)


def test_gaps_and_days(spark):
    hours = lambda *hs: as_rows(spark, [Span(DAY + h * HOUR, "hourly") for h in hs])
    assert merge.gaps(hours(*range(6)), hours(1, 2, 4)).first()[:] == (3, 2, 1)
    assert merge.gaps(hours(0, 1), hours(9)).first()[:] == (0, 2, 0)
    with pytest.raises(ValueError):
        merge.require_no_holes(merge.gaps(hours(*range(6)), hours(1, 4)))
    with pytest.raises(ValueError):
        merge.require_no_holes(merge.gaps(hours(0), hours(9)))
    wanted = as_rows(spark, [Span(DAY, "daily"), Span(DAY + 24 * HOUR, "daily")])
    assert merge.covering_windows(wanted, hours(*range(24), *range(24, 47))).count() == 24


def test_adoption(spark):
    columns = "include_bots boolean, limit int, param string, host string, paths string, countries string, rendered_only boolean, redirects string"
    rows = spark.createDataFrame([(False, 20, "q", None, None, None, False, None), (False, 50, "q", None, None, None, False, None), (True, 20, "q", None, None, None, False, None)], columns)
    alike = rows.filter("NOT include_bots")
    assert {r.adopted_limit for r in merge.adopted(alike, {"include_bots": False}).collect()} == {20}
    assert merge.adopted(alike, {"include_bots": False, "limit": 20, "bot_agents": None}).count() == 2
    for asked in ({"include_bots": False, "limit": 30}, {"host": "h"}, {"bot_agents": "x"}):
        with pytest.raises(ValueError):
            merge.adopted(alike, asked)
    for asked in ({}, {"include_bots": False}):
        with pytest.raises(ValueError):
            merge.adopted(rows, asked)


def test_a_run_lost_between_rows_and_ledger_leaves_old_answers(spark, log, tmp_path):
    from datetime import datetime

    store, q = SummaryStore(spark, str(tmp_path)), registry()["pageviews"]
    spans = [Span(DAY, "hourly")]
    store.write("pageviews", compute(log(row()), q, Request(), spans), spans, F.timestamp_millis(F.lit(DAY)))
    before = got(store.read("pageviews"), "path")
    run = store.write_rows("pageviews", compute(log(row(stem="/n"), row(stem="/n")), q, Request(), spans), datetime(2027, 1, 1))
    assert before and got(store.read("pageviews"), "path") == before
    assert [r.state for r in store.states("pageviews", as_rows(spark, spans)).collect()] == ["rows"]
    store.write_ledger("pageviews", spans, datetime(2027, 1, 1), run)
    assert got(store.read("pageviews"), "path") == [("/n",)]


def test_calendars_do_not_depend_on_the_session_zone(spark):
    log = spark.createDataFrame([(1_704_067_200_000 + h * HOUR,) for h in (-1, 0, 5, 13, 30 * 24, 90 * 24)], "ts_ms long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for session in ("UTC", "America/New_York", "Australia/Sydney"):
            spark.conf.set("spark.sql.session.timeZone", session)
            rows = [calendar.periods(calendar.local_days(log, z), z) for z in ("Europe/London", "Australia/Sydney")]
            text = [r.selectExpr("unit", "cast(starts_on AS string)", "unix_millis(`from`)", "unix_millis(until)") for r in rows]
            windows = [calendar.source_windows(r).groupBy("unit", "granularity").count() for r in rows]
            found.append([sorted(map(tuple, x.collect())) for x in (*text, *windows)])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1] == found[2]
    assert ("day", "2024-01-01", 1_704_067_200_000 - 11 * HOUR, 1_704_067_200_000 + 13 * HOUR) in found[0][1]


def test_a_report_is_refused_before_its_period_closes_and_survives_a_failing_section(spark):
    days = spark.createDataFrame([("2026-08-23",)], "day string").selectExpr("cast(day AS date) AS day")
    every = calendar.periods(days, "UTC").filter("unit = 'day'")
    at = lambda text: F.lit(text).cast("timestamp")
    assert calendar.require_closed(every, at("2026-08-24 00:00:00")).count() == 1
    with pytest.raises(ValueError):
        calendar.require_closed(every, at("2026-08-23 23:59:59"))
    with pytest.raises(ValueError):
        reports.computed({}, 2, 1)

    def fails():
        raise ValueError("no such window")

    values, errors = reports.computed({"a": lambda: spark.range(1), "b": fails}, 1, 1)
    assert list(values) == ["a"] and errors == {"b": "no such window"}
    stored = spark.createDataFrame([(1, "other", "daily")], "views long, question string, granularity string").withColumns({"path": F.lit("/"), "window_start": F.timestamp_millis(F.lit(DAY))})
    kept = stored.withColumn("question", F.lit("pageviews"))
    assert got(reports.summarised(kept, stored, registry()["pageviews"], limit=1), "path", "views") == [("/", 1)]
    for rows in (stored, stored.drop("question").drop("path"), kept.withColumn("version", F.lit(9)), kept.withColumn("views", F.lit(True))):
        dropped = reports.summarised(rows, stored, registry()["pageviews"])
        assert dropped.count() == 0 and {"path", "views"} <= set(dropped.columns)


def test_digest_lines(spark):
    definition = compare.definitions()["searches", "rows"]
    side = lambda rows: spark.createDataFrame(rows, "term string, searches long, redirected long")
    rows = compare.compared(side([("a", 15, 2), ("b", 3, 1), (None, 9, 0)]), side([("a", 10, 2), ("b", 0, 3), ("gone", 99, 9)]), definition)
    lines = compare.digest_rows(rows, ["term"], definition, 2).orderBy("place").collect()
    assert [(r.line, r.omitted) for r in lines] == [
        ("term=a: searches 15 searches (+50%), redirected 2 searches (0%)", 1),
        ("searches 9 searches (comparison unavailable), redirected 0 searches (comparison unavailable)", 1),
    ]


def test_store_states_and_overwrite(spark, log, tmp_path):
    store = SummaryStore(spark, str(tmp_path))
    spans = [Span(DAY, "hourly"), Span(DAY + HOUR, "hourly")]
    q = registry()["pageviews"]
    now = F.timestamp_millis(F.lit(DAY + 5 * HOUR))
    store.write("pageviews", compute(log(row(), row(at=HOUR)), q, Request(), spans), spans, now, limit=20)
    later = F.timestamp_millis(F.lit(DAY + 6 * HOUR))
    store.write("pageviews", compute(log(row(stem="/n")), q, Request(), spans), spans, later, limit=20)
    wanted = as_rows(spark, [*spans, Span(DAY + 2 * HOUR, "hourly")])
    assert [r.state for r in store.states("pageviews", wanted).orderBy("window_start").collect()] == ["rows", "empty", "never computed"]
    assert got(store.read("pageviews"), "path") == [("/n",)]
    assert merge.freshness(store.ledger("pageviews")).first()["windows"] == 2
    small = store.compacted("pageviews", str(tmp_path / "compacted"))
    assert spark.read.parquet(f"{small.root}/rows/name=pageviews").count() == 1 < spark.read.parquet(f"{store.root}/rows/name=pageviews").count()
    assert got(small.read("pageviews"), "path") == [("/n",)] and small.ledger("pageviews").count() == 2


def test_only_wanted_days_are_listed_and_busy_ones_are_dealt_over_tasks(spark, log, tmp_path):
    rows = log(*[row(at=h * HOUR // 60) for h in range(300)], row(at=48 * HOUR), row(at=96 * HOUR))
    day = F.timestamp_millis("ts_ms")
    parts = {"distributionid": F.lit("D1"), "year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
    source.curate(rows.withColumns(parts), str(tmp_path), "daily")
    again = source.read_parquet(spark, str(tmp_path), granularity="daily", curated=True)
    assert again.count() == 302
    spans = [Span(DAY, "daily"), Span(DAY + 96 * HOUR, "hourly")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    answer = compute(again, registry()["pageviews"], Request(), spans)
    assert sorted(got(answer, "granularity", "views")) == [("daily", 300), ("hourly", 1)]
    assert len(again.select("year", "month", "day").distinct().collect()) == 3
    scan = next(x for x in answer._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "concat_ws(-, year" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_log_sources(spark, tmp_path):
    folder = tmp_path / "distributionid=D1/year=2026/month=08/day=23/hour=04"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"timestamp(ms)": str(DAY), "cs(User-Agent)": "x", "cs-method": "GET", "other": 1}) + "\n" + json.dumps({"timestamp(ms)": "-"}) + "\n")
    log = source.read_json(spark, str(tmp_path))
    assert got(log.orderBy("timestamp_ms"), "ts_ms", "cs_user_agent", "c_ip", "hour", "month") == [(None, None, None, "04", "08"), (DAY, "x", None, "04", "08")]
    source.curate(log, str(tmp_path / "curated"))
    again = source.read_parquet(spark, str(tmp_path / "curated"))
    typed = pruned(source.read_parquet(spark, str(tmp_path / "curated"), curated=True), TimeRange(DAY, DAY + 1))
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert typed.count() == 1 and "GreaterThanOrEqual(ts_ms" in plan and "PartitionFilters: [isnotnull(year" in plan
    assert again.count() == 2 and source.one_distribution(again, "D2").count() == 0 and source.together([again, again]).count() == 4
    assert source.chosen_columns(["cs-method"], viewer_address=False) == ["timestamp_ms", "cs_method"]
    with pytest.raises(ValueError):
        source.chosen_columns(["nope"])
    with pytest.raises(ValueError):
        source.together([again, again.drop("c_ip")])


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', None), ("x\ny", 2)], "t string, n int").coalesce(1)
    write_csv(rows, str(tmp_path / "c"))
    write_csv(rows.filter("n > 5"), str(tmp_path / "e"))
    write_json(rows, str(tmp_path / "j"))
    text = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("part-*"))
    assert text("c") == 't,n\n"a ""b"", c",\n"x\ny",2\n' and text("e") == "t,n\n"
    assert '"n":null' in text("j")


def test_calendar(spark):
    days = spark.createDataFrame([("2026-03-29",), ("2026-10-25",)], "d string").selectExpr("to_date(d) AS day")
    rows = {(r.unit, str(r.starts_on)): r for r in calendar.periods(days, "Europe/London").withColumn("hours", (F.unix_timestamp("until") - F.unix_timestamp("from")) / 3600).collect()}
    assert rows["day", "2026-03-29"].hours == 23 and rows["day", "2026-10-25"].hours == 25
    assert ("week", "2026-03-23") in rows and str(rows["month", "2026-10-01"].until) == "2026-11-01 00:00:00"
    sunday = calendar.periods(days, "UTC", "sunday")
    assert {str(r.starts_on) for r in sunday.filter("unit = 'week'").collect()} == {"2026-03-29", "2026-10-25"}
    every = calendar.periods(days, "UTC")
    assert calendar.closed(every, F.lit("2026-03-30 00:00:00").cast("timestamp")).count() == 2
    ends = calendar.closing_with_days(every).orderBy("rank").collect()
    assert [(str(r.day), r.unit) for r in ends if str(r.day) == "2026-03-29"] == [("2026-03-29", "week"), ("2026-03-29", "day")]
    assert calendar.selected("2026-08") == ("month", datetime(2026, 8, 1).date())
    for bad in ("2026-02-30", "26", "2026-13"):
        with pytest.raises(ValueError):
            calendar.selected(bad)
    half = calendar.periods(days, "Asia/Kolkata")
    assert calendar.source_windows(half).count() == 0
    assert {r.granularity for r in calendar.source_windows(calendar.periods(days, "Europe/London")).filter("unit = 'day' AND starts_on = '2026-03-29'").collect()} == {"hourly"}


def test_sections_and_document(spark, log):
    assert reports.calculation(registry()["cache-hit-ratio"]) == "period-query" == reports.calculation(registry()["web-vitals"])
    assert reports.calculation(registry()["pageviews"]) == "summaries"
    sections = spark.createDataFrame([("a", "additive", "summaries", 0, 4), ("b", "ranked", "summaries", 0, 4), ("c", "ranked", "summaries", 0, 4), ("d", "missing", "summaries", 0, 4), ("e", "percentile", "summaries", 0, 4), ("f", "percentile", "summaries", 0, 4)], "section string, rule string, calculation string, period_from int, period_until int")
    windows = spark.createDataFrame([(s, a, a + 2) for s in "abe" for a in (0, 2)] + [("c", 0, 2), ("f", 0, 4)], "section string, from int, until int")
    judged = reports.judged_sections(windows, sections)
    assert {r.section: (r.accuracy, r.composition, r.reason) for r in judged.collect()} == {
        "a": ("exact", "additive", None), "b": ("approximate", "ranked-summaries", None), "c": ("unavailable", "none", "incomplete-source"),
        "d": ("unavailable", "none", "missing-rollup"), "e": ("unavailable", "none", "percentiles-do-not-compose"), "f": ("exact", "single-summary", None),
    }
    assert reports.coverage(judged).first()[:] == (0, 4, False, 5)
    document = reports.document(judged, {"a": registry()["pageviews"].answer(log(row()))}).orderBy("section").collect()
    assert json.loads(document[0].value) == [{"path": "/", "views": 1}] and document[1].value is None


def test_report_store(spark, tmp_path):
    rows = spark.createDataFrame([("UTC", "day", "monday", "2026-08-23", "{}")], "zone string, unit string, week_start string, starts_on string, value string")
    store = ReportStore(spark, str(tmp_path / "r"))
    store.write(rows)
    store.write(rows.withColumn("value", F.lit("[]")))
    assert got(store.read(unit="day", starts_on="2026-08-23"), "value") == [("[]",)]


def test_comparison(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, views long")
    out = {r.path: r for r in compare.compared(table([("/a", 6), ("/n", 1), (None, 2), ("/z", 5)]), table([("/a", 4), ("/o", 9), (None, 2), ("/z", 0)]), compare.definitions()["pageviews", "rows"]).collect()}
    assert (out["/a"].change, out["/a"].trend, out["/a"].assessment) == (50.0, "increase", "unrated")
    assert out["/n"].reason == out["/o"].reason == "ranked-row-absent" and out["/n"].previous is None
    assert out[None].trend == out[None].assessment == "unchanged" and out["/z"].change_reason == "zero-baseline" and out["/z"].change is None
    vitals = lambda p: spark.createDataFrame([("lcp", p, 3), ("cls", None, 1)], "vital string, p75 double, samples long")
    rows = {(r.vital, r.metric): r for r in compare.compared(vitals(2.0), vitals(4.0), compare.definitions()["web-vitals", "rows"]).collect()}
    assert rows["lcp", "p75"].assessment == "improvement" and rows["lcp", "p75"].unit == "milliseconds"
    assert rows["cls", "p75"].reason == "metric-value-unavailable"
    own = compare.Definition("pageviews", (compare.Metric("views", "x", preference="higher-is-better"),))
    assert compare.compared(table([("/a", 1)]), table([("/a", 2)]), compare.definitions([own])["pageviews", "rows"]).first()["assessment"] == "regression"
    assert compare.as_table(spark, compare.DEFINITIONS).count() == 13


def test_periods_must_follow_each_other(spark):
    days = spark.createDataFrame([("2026-08-23",), ("2026-08-22",), ("2026-08-20",)], "d string").selectExpr("to_date(d) AS day")
    every = calendar.periods(days, "UTC").filter("unit = 'day'")
    day = lambda d: every.filter(F.col("starts_on") == d)
    reports.require_preceding(day("2026-08-23"), day("2026-08-22"))
    for other in ("2026-08-20", "2026-08-23"):
        with pytest.raises(ValueError):
            reports.require_preceding(day("2026-08-23"), day(other))
    rows = reports.manifest(calendar.closing_with_days(calendar.periods(days, "Europe/London")), "Europe/London").collect()
    keys = {(str(r.day), r.unit): (r.current_key, r.previous_key) for r in rows}
    assert keys["2026-08-23", "week"] == ("Europe-London/week/week-starts-monday/2026-08-17", "Europe-London/week/week-starts-monday/2026-08-10")


def test_section_pairs(spark):
    sections = lambda names: spark.createDataFrame(list(enumerate(names)), "at int, question string")
    pairs = compare.paired_sections(sections("aab"), sections("ac"))
    assert {(r.question, r.nth, r.current_at, r.previous_at) for r in pairs.collect()} == {("a", 1, 0, 0), ("a", 2, 1, None), ("b", 1, 2, None), ("c", 1, None, 1)}
    side = "{0}_question_text string, {0}_complete boolean, {0}_accuracy string, {0}_value_type string, {0}_columns array<string>, {0}_defined boolean"
    same = ("q", True, "exact", "rows", ["x"], True)
    cases = [(0, 0, *same, *same), (None, 0, *same, *same), (0, 0, *same, "r", *same[1:]), (0, 0, *same, "q", False, *same[2:]), (0, 0, *same, "q", True, "unavailable", *same[3:]), (0, 0, *same, *same[:4], ["y"], True), (0, 0, "q", True, "approximate", *same[3:], *same)]
    frame = spark.createDataFrame(cases, f"current_at int, previous_at int, {side.format('c')}, {side.format('p')}").withColumn("c_metrics", F.array(F.lit("x")))
    assert compare.comparability(frame.limit(1).withColumn("c_metrics", F.array(F.lit("z")))).first()["reason"] == "columns-mismatch"
    assert [(r.reason, r.accuracy) for r in compare.comparability(frame).collect()] == [(None, "exact"), ("section-absent", None), ("question-mismatch", None), ("incomplete-source", None), ("section-unavailable", None), ("columns-mismatch", None), (None, "approximate")]


def test_window_cap_is_pushed_below_the_shuffle(log):
    plan = registry()["beacon-totals"].answer(log(beacon("v=2&b=a%252C%252C1")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_windows_keep_their_names():
    assert WINDOW == ["granularity", "window_start"]
