"""Zones and their skipped dates, write-once manifests, report snapshots, sections out of the store, deadlines and sketches."""

import json
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelens.functions.visitors import day_salts
from sitelens.operators import compare
from sitelens.operators.questions import approximate_visitors, registry, visitor_sketches, visitors
from sitelens.plans import calendar, reports
from sitelens.plans.backfill import backfill, lacking
from sitelens.plans.identity import identity
from sitelens.plans.request import HOUR, Request
from sitelens.plans.windows import WINDOW, Span, compute, matrix, with_windows
from sitelens.derived_log import access_log
from sitelens.sources.once import create_once, read_text
from sitelens.sources.stores import ReportStore, SummaryStore

DAY = 24 * HOUR
START = 1_704_844_800_000  # 2024-01-10
ALL = Request(limit=None)


def now():
    return F.timestamp_millis(F.lit(START + 30 * DAY))


@pytest.fixture(scope="module")
def log(spark):
    return access_log(spark, "/root/testdata/sf0.001").cache()


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def days(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "d string").selectExpr("to_date(d) AS day")


# -- zones -----------------------------------------------------------------------


def length(spark, zone, text):
    row = calendar.periods(days(spark, text), zone).filter("unit = 'day'").selectExpr("(unix_millis(until) - unix_millis(`from`)) / 3600000D AS h", "unix_millis(`from`) AS f").first()
    return row.h, row.f


def test_days_of_23_25_and_24_hours(spark):
    assert [length(spark, "Europe/London", d)[0] for d in ("2026-03-29", "2026-10-25", "2026-06-01")] == [23, 25, 24]
    assert [length(spark, "America/New_York", d)[0] for d in ("2024-03-10", "2024-11-03")] == [23, 25]
    # Midnight is skipped in Sao Paulo: the day begins at one o'clock, and the day before is whole.
    hours, first = length(spark, "America/Sao_Paulo", "2018-11-04")
    assert hours == 23 and first == 1_541_300_400_000 and length(spark, "America/Sao_Paulo", "2018-11-03")[0] == 24
    assert length(spark, "America/Sao_Paulo", "2018-02-17")[0] == 25
    assert length(spark, "Australia/Lord_Howe", "2024-04-07")[0] == 24.5


def test_skipped_dates(spark):
    """Samoa went from 29 to 31 December 2011."""
    apia = calendar.periods(days(spark, "2011-12-29", "2011-12-31"), "Pacific/Apia")
    told = {(r.unit, str(r.starts_on)): str(r.previous_starts_on) for r in calendar.previous(apia, "Pacific/Apia").collect()}
    assert told["day", "2011-12-31"] == "2011-12-29" and told["day", "2011-12-29"] == "2011-12-28" and told["month", "2011-12-01"] == "2011-11-01"
    assert told["week", "2011-12-26"] == "2011-12-19" and told["year", "2011-01-01"] == "2010-01-01"
    with pytest.raises(ValueError, match="there is no 2011-12-30"):
        calendar.selected_period(spark, "2011-12-30", "Pacific/Apia")
    assert calendar.selected_period(spark, "2011-12-30", "UTC").first()["starts_on"] == date(2011, 12, 30)
    assert calendar.selected_period(spark, "2026-08-23", "Europe/London", "sunday", week=True).first()["starts_on"] == date(2026, 8, 23)
    assert calendar.selected_period(spark, "2026-08", "Europe/London").first()["unit"] == "month"
    for text, week in (("2026-13", False), ("2026-02-30", False), ("26", False), ("2026-08", True)):
        with pytest.raises(ValueError):
            calendar.selected_period(spark, text, "UTC", week=week)


def test_transitions(spark):
    told = lambda zone, a, b: [(r.ms, r.minutes_before, r.minutes_after) for r in calendar.transitions(spark, zone, a, b).selectExpr("unix_millis(instant) AS ms", "minutes_before", "minutes_after").orderBy("ms").collect()]
    assert told("Europe/London", 2026, 2026) == [(1_774_746_000_000, 0, 60), (1_792_890_000_000, 60, 0)]
    assert told("UTC", 2020, 2026) == [] and told("Pacific/Apia", 2011, 2011)[-1] == (1_325_239_200_000, -600, 840)
    assert [b - a for _, a, b in told("Australia/Lord_Howe", 2024, 2024)] == [-30, 30]


# -- manifests and reports ---------------------------------------------------------


def test_of_racing_writers_one_writes(spark, tmp_path):
    path, said = f"file://{tmp_path}/a/b.json", []
    racers = [threading.Thread(target=lambda k=k: said.append((create_once(spark, path, f"writer {k}"), k))) for k in range(8)]
    for r in racers:
        r.start()
    for r in racers:
        r.join()
    (winner,) = [k for ok, k in said if ok]
    assert len(said) == 8 and read_text(spark, path) == f"writer {winner}" and len(list((tmp_path / "a").iterdir())) == 1
    assert not create_once(spark, str(tmp_path / "a" / "b.json"), "x")


def test_a_manifest_is_announced_once(spark, tmp_path):
    closing = calendar.closing_with_days(calendar.periods(days(spark, "2026-08-22", "2026-08-23", "2026-08-31"), "Europe/London"))
    made = reports.manifest(closing, "Europe/London")
    first = reports.announce(spark, str(tmp_path), made, "Europe/London", ["week", "month"], "t0")
    assert first == {f"notifications/Europe-London/{d}.json": "written" for d in ("2026-08-23", "2026-08-31")}
    again = reports.announce(spark, str(tmp_path), made, "Europe/London", ["week", "month"], "t1")
    assert set(again.values()) == {"already there"} and reports.announce(spark, str(tmp_path), made, "Europe/London", [], "t2") == {}
    text = json.loads(read_text(spark, f"{tmp_path}/notifications/Europe-London/2026-08-23.json"))
    assert text["created_at"] == "t0" and text["reports"] == [{"unit": "week", "current": "Europe-London/week/week-starts-monday/2026-08-17", "previous": "Europe-London/week/week-starts-monday/2026-08-10"}]


def test_a_report_lost_before_its_pointer_leaves_the_old_one(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path))
    made = lambda value, day="2026-08-23": spark.createDataFrame([("Europe/London", "day", "monday", day, value)], "zone string, unit string, week_start string, starts_on string, value string")
    read = lambda: [r.value for r in store.read(unit="day", starts_on="2026-08-23").collect()]
    store.write(made("old").unionByName(made("other", "2026-08-24")))
    snapshot, keys = store.write_snapshot(made("new"))
    assert read() == ["old"]
    store.point(snapshot, keys)
    assert read() == ["new"] and store.read().count() == 2 and store.snapshots(starts_on="2026-08-23").count() == 2
    store.point(*store.write_snapshot(made("later")), version=9)
    with pytest.raises(ValueError, match="version 9"):
        read()
    assert store.read(starts_on="2026-08-24").count() == 1


def test_sections_drop_what_does_not_match(spark, log, tmp_path):
    store, q = SummaryStore(spark, str(tmp_path)), registry()["pageviews"]
    asked, other = Request(limit=3), Request(limit=3, host="blog.example.com")
    spans = [Span(START + k * DAY, "daily") for k in range(4)]
    store.write("views", compute(log, q, asked, spans[:3]), spans[:3], now(), identity(q, asked))
    store.write("views", compute(log, q, other, spans[3:]), spans[3:], now(), identity(q, other))
    answer, sources = reports.stored_section(store, "views", q, asked, spans)
    assert answer.count() == 3 and sources.count() == 3
    sections = spark.createDataFrame([("views", "ranked", "summaries")], "section string, rule string, calculation string")
    bounds = {"period_from": F.timestamp_millis(F.lit(START)), "period_until": F.timestamp_millis(F.lit(START + 4 * DAY))}
    assert reports.judged_sections(sources, sections.withColumns(bounds)).first()["reason"] == "incomplete-source"
    want = compute(log, q, asked, spans[:3]).groupBy("path").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "path").limit(3)
    assert rows(answer) == rows(want)
    none, sources = reports.stored_section(store, "views", q, Request(limit=9), spans)
    assert none is None and sources.count() == 0
    one, _ = reports.stored_section(store, "views", q, asked, spans[:1])
    assert rows(one) == rows(compute(log, q, asked, spans[:1]).drop(*WINDOW))


def test_digests_keep_the_order_of_the_comparison(spark):
    definition = compare.definitions()["web-vitals", "rows"]
    side = lambda told: spark.createDataFrame(told, "vital string, p75 double, samples long")
    lines = compare.digest_rows(compare.compared(side([("lcp", 900.0, 2), ("cls", 0.1, 9)]), side([("lcp", 800.0, 1)]), definition), ["vital"], definition)
    assert [r.line.split(":")[0] for r in lines.orderBy("place").collect()] == ["vital=cls", "vital=lcp"]
    none = compare.digest_rows(compare.compared(side([]), side([("lcp", 1.0, 1)]), definition), ["vital"], definition)
    assert [tuple(r) for r in none.collect()] == [(1, "No rows.", 0)]


# -- deadlines and sketches ----------------------------------------------------------


def test_two_short_backfills_are_a_whole_one(spark, log, tmp_path):
    q = registry()["status-codes"]
    scheduled = matrix([("statuses", q, ["daily"], ALL), ("views", registry()["pageviews"], ["daily", "hourly"], ALL)])
    spans = [*[Span(START + k * DAY, "daily") for k in range(6)], *[Span(START + k * HOUR, "hourly") for k in range(6)]]
    store = SummaryStore(spark, str(tmp_path))
    ticks = iter(range(0, 10_000, 10))
    clock = lambda: float(next(ticks))
    assert len(lacking(store, scheduled, spans)) == 12
    first = backfill(log, store, scheduled, spans, now(), 60, first=2, reserve=5, clock=clock)
    assert 2 <= len(first.computed) < 12 and first.computed + first.rest == tuple(sorted(spans)) and first.chunks >= 1
    second = backfill(log, store, scheduled, spans, now(), 600, first=2, reserve=5, clock=clock)
    assert second.computed == first.rest and not second.rest and lacking(store, scheduled, spans) == []
    own = [s for s in spans if s.granularity == "daily"]
    assert rows(store.read("statuses", own).drop("computed_at").select("status", "responses", *WINDOW)) == rows(compute(log, q, ALL, own).select("status", "responses", *WINDOW))
    none = backfill(log, store, scheduled, spans, now(), 0, clock=clock)
    assert none.computed == none.rest == () and none.chunks == 0


def test_sketches_merge_to_near_the_exact_count(spark):
    log = access_log(spark, "/root/testdata/sf0.1")
    salts = day_salts(spark, "s", [f"2024-01-{d:02}" for d in range(1, 32)])
    windows = with_windows(log, ["daily"])
    sketches = visitor_sketches(windows, ALL, salts, WINDOW)
    exact = visitors(log, ALL, salts).first()["distinct_visitors"]
    merged, direct = approximate_visitors(sketches).first(), approximate_visitors(visitor_sketches(log, ALL, salts, [])).first()
    assert abs(merged.approximate_visitors - exact) <= 0.03 * exact and 0 < merged.relative_error < 0.01
    assert abs(merged.approximate_visitors - direct.approximate_visitors) <= 0.015 * exact  # a union estimates otherwise than one sketch
    by_day = {r.window_start: r.distinct_visitors for r in visitors(windows, ALL, salts, WINDOW).collect()}
    for r in approximate_visitors(sketches, WINDOW).collect():
        assert abs(r.approximate_visitors - by_day[r.window_start]) <= 0.04 * by_day[r.window_start]
    assert approximate_visitors(sketches.limit(0)).first()["approximate_visitors"] == 0
