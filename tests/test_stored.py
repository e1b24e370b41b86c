"""Stored answers of a range, pruned reads, identity of requests, and the matrix of questions."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators.questions import registry
from sitelens.operators.rows import rows_for
from sitelens.plans.identity import adopted, identity
from sitelens.plans.matrix import columns_of, compute_matrix, run
from sitelens.plans.request import HOUR, Request, TimeRange
from sitelens.plans.stored import Piece, answered, candidates, cover, without_gaps
from sitelens.plans.windows import WINDOW, Scheduled, Span, compute, matrix
from sitelens.derived_log import access_log, flooded
from sitelens.sources.stores import SummaryStore, in_days

DAY = 24 * HOUR
START = 1_704_844_800_000  # 2024-01-10
ALL = Request(limit=None)


def now():
    return F.timestamp_millis(F.lit(START + 30 * DAY))


def hours(start, end):
    return [Span(t, "hourly") for t in range(start, end, HOUR)]


def days(start, end):
    return [Span(t, "daily") for t in range(start, end, DAY)]


@pytest.fixture(scope="module")
def log(spark):
    return access_log(spark, "/root/testdata/sf0.001").cache()


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# -- covering a range ----------------------------------------------------------


def test_a_week_is_read_from_52_windows_at_most():
    have = set(hours(START - DAY, START + 9 * DAY)) | set(days(START - DAY, START + 9 * DAY))
    for at in (0, 1, HOUR, 90 * 60_000, 23 * HOUR + 1):
        pieces = cover(TimeRange(START + at, START + at + 7 * DAY - 1), have)
        assert len(pieces) <= 52 and all(a.end == b.start for a, b in zip(pieces, pieces[1:]))
        assert pieces[0].start - START - at in range(HOUR) and pieces[-1].end <= START + at + 7 * DAY
    assert len(cover(TimeRange(START, START + 7 * DAY - 1), have)) == 7


def test_cheapest_cover_matches_every_path():
    """Held against all ways through a day and a half."""
    rng = random.Random(4)
    for _ in range(40):
        start = START + 18 * HOUR
        have = {w for w in [*hours(start, start + 36 * HOUR), *days(START + DAY, START + 2 * DAY)] if rng.random() < 0.8}
        price = rng.choice([0.5, 2, 50])
        pieces = cover(TimeRange(start, start + 36 * HOUR - 1), have, True, price)
        spent = sum(price * (p.end - p.start) / HOUR if p.source == "log" else 1 for p in pieces)
        best = {start + 36 * HOUR: 0.0}
        for t in range(start + 35 * HOUR, start - HOUR, -HOUR):
            ways = [price + best[t + HOUR], *([1 + best[t + HOUR]] if Span(t, "hourly") in have else []), *([1 + best[t + DAY]] if Span(t, "daily") in have and t + DAY in best else [])]
            best[t] = min(ways)
        assert spent == pytest.approx(best[start])


def test_gaps_at_ends_are_skipped_and_holes_refused():
    span = TimeRange(START, START + 10 * HOUR - 1)
    pieces, skipped = without_gaps(cover(span, hours(START + 2 * HOUR, START + 7 * HOUR)))
    assert (len(pieces), skipped) == (5, 5)
    with pytest.raises(ValueError, match="1 hours are missing"):
        without_gaps(cover(span, [h for h in hours(START, START + 10 * HOUR) if h.start != START + 4 * HOUR]))
    for have in ([], days(START, START + DAY)):
        with pytest.raises(ValueError, match="no stored window"):
            without_gaps(cover(span, have))
    edges = cover(TimeRange(START + 5, START + 3 * HOUR + 5), hours(START, START + 4 * HOUR), True)
    assert [p.source for p in edges] == ["log", "hourly", "hourly", "log"]
    assert cover(TimeRange(START + 5, START + 9), [], True) == [Piece(START + 5, START + 10, "log")] and cover(TimeRange(START + 5, START + 9), []) == []
    assert {w.granularity for w in candidates(TimeRange(START, START + DAY - 1))} == {"hourly", "daily"} and len(candidates(TimeRange(START, START + DAY - 1))) == 25


# -- answers -------------------------------------------------------------------


@pytest.fixture(scope="module")
def filled(spark, log, tmp_path_factory):
    """Two weeks of status codes, the fourth day as hours alone and the sixth not at all."""
    store, q = SummaryStore(spark, str(tmp_path_factory.mktemp("store"))), registry()["status-codes"]
    gone, split = START + 5 * DAY, START + 3 * DAY
    spans = [w for w in [*hours(START, START + 14 * DAY), *days(START, START + 14 * DAY)] if not gone <= w.start < gone + DAY and w != Span(split, "daily")]
    store.write("statuses", compute(log, q, ALL, spans), spans, now(), identity(q, ALL))
    return store


def fresh(log, question, span, request=ALL):
    return rows(question.answer(log, Request(**{**request.__dict__, "span": span})))


def test_stored_answer_equals_a_fresh_one(log, filled):
    q = registry()["status-codes"]
    span = TimeRange(START + 30 * 60_000, START + 5 * DAY - 40 * 60_000)
    got = answered(filled, "statuses", q, span, ALL)
    whole = TimeRange(START + HOUR, START + 5 * DAY - HOUR - 1)
    assert rows(got.rows) == fresh(log, q, whole) and got.span == whole
    assert got.windows == 23 + 1 + 1 + 24 + 23 and got.skipped_hours == 0 and got.computed_at is not None
    edges = answered(filled, "statuses", q, span, ALL, log=log)
    assert rows(edges.rows) == fresh(log, q, span) and [p.source for p in edges.pieces].count("log") == 2
    over = TimeRange(START + 4 * DAY, START + 8 * DAY - 1)
    with pytest.raises(ValueError, match="24 hours are missing"):
        answered(filled, "statuses", q, over, ALL)
    bridged = answered(filled, "statuses", q, over, ALL, log=log)
    assert rows(bridged.rows) == fresh(log, q, over) and [p.source for p in bridged.pieces] == ["daily", "log", "daily", "daily"]
    one = answered(filled, "statuses", q, TimeRange(START, START + DAY - 1), Request(limit=2))
    assert [tuple(r) for r in one.rows.collect()] == fresh(log, q, TimeRange(START, START + DAY - 1))[:0] + [tuple(r) for r in q.answer(log, Request(limit=2, span=TimeRange(START, START + DAY - 1))).collect()]
    with pytest.raises(ValueError, match="no stored window"):
        answered(filled, "nothing", q, over, ALL)


def test_narrowings_are_adopted_or_refused(spark, log, tmp_path):
    store, q = SummaryStore(spark, str(tmp_path)), registry()["pageviews"]
    spans = days(START, START + 3 * DAY)
    british = Request(countries=("GB",), limit=3)
    store.write("views", compute(log, q, british, spans), spans, now(), identity(q, british))
    span = TimeRange(START, START + 3 * DAY - 1)
    got = answered(store, "views", q, span)
    assert got.request.countries == ("GB",) and got.request.limit == 3 and len(got.taken) == 2
    with pytest.raises(ValueError, match="countries"):
        answered(store, "views", q, span, named={"countries"})
    with pytest.raises(ValueError, match="3 rows"):
        answered(store, "views", q, span, Request(limit=9), named={"limit"})
    # An answer over all countries stands beside it, and neither is taken for the other.
    store.write("views", compute(log, q, ALL, spans), spans, now(), identity(q, ALL))
    with pytest.raises(ValueError, match="several ways"):
        store.read("views", spans)
    every = answered(store, "views", q, span, ALL)
    assert rows(every.rows) == fresh(log, q, span) and not every.taken
    again = answered(store, "views", q, span, british, named={"countries", "limit"})
    assert again.request == british and sum(r.views for r in again.rows.collect()) < sum(r.views for r in every.rows.collect())
    # With a log at hand, what was narrowed otherwise is scanned.
    french = answered(store, "views", q, span, Request(countries=("FR",), limit=None), log=log)
    assert rows(french.rows) == fresh(log, q, span, Request(countries=("FR",), limit=None)) and french.windows == 0


def test_questions_that_do_not_add_up(spark, log, tmp_path):
    store, q = SummaryStore(spark, str(tmp_path)), registry()["web-vitals"]
    spans = days(START, START + 2 * DAY)
    store.write("vitals", compute(log, q, ALL, spans), spans, now(), identity(q, ALL))
    one, two = TimeRange(START, START + DAY - 1), TimeRange(START, START + 2 * DAY - 1)
    assert rows(answered(store, "vitals", q, one, ALL).rows) == fresh(log, q, one)
    with pytest.raises(ValueError, match="does not combine"):
        answered(store, "vitals", q, two, ALL)
    assert rows(answered(store, "vitals", q, two, ALL, log=log).rows) == fresh(log, q, two)


def test_adoption_of_bots_and_old_ledgers(spark):
    q = registry()["searches"]
    stored = [identity(q, Request(include_bots=True, param="s"))] * 2
    request, taken = adopted(q, Request(bot_agents=("x",)), {"bot_agents"}, stored)
    assert request.include_bots and request.param == "s" and len(taken) == 2
    with pytest.raises(ValueError, match="more than one way"):
        adopted(q, Request(), (), [identity(q, Request(host="a")), identity(q, Request(host="b"))])
    other = registry()["pageviews"]
    assert identity(other, Request(param="s"))["digest"] == identity(other, Request())["digest"] != identity(other, Request(host="h"))["digest"]
    assert identity(other, Request(countries=("GB", "DE", "GB"), limit=5))["digest"] == identity(other, Request(countries=("DE", "GB")))["digest"]


def files_read(frame):
    """Files that a scan without shuffles opens, as its metric tells."""
    execution = frame._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_reads_are_pruned_to_their_days(spark, log, tmp_path):
    store, q = SummaryStore(spark, str(tmp_path)), registry()["pageviews"]
    spans = days(START, START + 14 * DAY)
    store.write("views", compute(log, q, ALL, spans), spans, now(), identity(q, ALL))
    wanted = spans[3:5]
    frame = store.read("views", wanted)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "window_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.window_start.timestamp() * 1000 for r in frame.select("window_start").distinct().collect()} == {w.start for w in wanted}
    # Only these directories are listed, and a day without any file is none.
    assert {f.split("window_day=")[1].split("/")[0] for f in frame.inputFiles()} == {str(w.start // DAY) for w in wanted}
    assert store.read("views", [*wanted, *days(START + 300 * DAY, START + 301 * DAY)]).count() == frame.count()
    for part in ("rows", "ledger"):
        whole = spark.read.parquet(f"{store.root}/{part}/name=views")
        assert files_read(whole.filter(in_days(wanted))) < files_read(whole) and files_read(whole.filter(in_days(wanted))) <= 2
    assert rows(store.read("views").filter(F.col("window_start").isin(*[F.timestamp_millis(F.lit(w.start)) for w in wanted]))) == rows(frame)
    assert store.ledger("views", wanted).count() == 2 and store.ledger("nothing").count() == 0


def test_empty_windows_and_runs_of_other_columns(spark, log, tmp_path):
    store, q = SummaryStore(spark, str(tmp_path)), registry()["pageviews"]
    far = days(START + 400 * DAY, START + 402 * DAY)
    store.write("views", compute(log, q, ALL, far), far, now(), identity(q, ALL))
    near = days(START, START + DAY)
    store.write("views", compute(log, q, ALL, near).withColumn("more", F.lit(1)), near, now(), identity(q, ALL))
    assert store.read("views", far).count() == 0 and answered(store, "views", q, TimeRange(far[0].start, far[1].start + DAY - 1), ALL).rows.count() == 0
    assert {"path", "more"} <= set(store.read("views", near).columns)


def test_a_flooding_sender_is_spread(spark):
    """One sender of a third of all rows; no task of the lookup holds twice the median."""
    plain = access_log(spark, "/root/testdata/sf0.01").filter("c_ip IS NOT NULL AND cs_user_agent IS NOT NULL")
    sender = plain.filter("sc_content_type LIKE 'text/html%' AND cs_uri_stem NOT LIKE '/_beacon%'").select("c_ip", "cs_user_agent").first()
    mine = (F.pmod(F.hash("ts_ms", "cs_uri_stem"), F.lit(3)) == 0)
    busy = plain.withColumns({c: F.when(mine, F.lit(sender[c])).otherwise(F.col(c)) for c in ("c_ip", "cs_user_agent")}).cache()
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        most = {}
        for spread in (False, True):
            request = Request(include_bots=True, rendered_only=True, spread_senders=spread, limit=None)
            looked_up = rows_for(busy, request)
            sizes = sorted(r["count"] for r in looked_up.groupBy(F.spark_partition_id().alias("task")).count().collect())
            most[spread] = (sizes[-1] / sizes[len(sizes) // 2], sum(sizes))
            assert rows(registry()["pageviews"].answer(busy, request)) == rows(registry()["pageviews"].answer(busy, Request(include_bots=True, rendered_only=True, limit=None)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most[True][0] <= 2 < most[False][0] and most[True][1] == most[False][1]


# -- the matrix ----------------------------------------------------------------

SIX = ["pageviews", "referrers", "browsers", "status-codes", "cache-hit-ratio", "searches"]


def test_six_questions_at_two_cadences_are_one_scan(log, spark):
    plain = access_log(spark, "/root/testdata/sf0.001")
    scheduled = matrix([(n, registry()[n], ["hourly", "daily"], Request(limit=3)) for n in SIX])
    spans = [*hours(START, START + 2 * DAY), *days(START, START + 2 * DAY)]
    plan = compute_matrix(plain, scheduled, spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_the_matrix_gives_what_each_question_gives(spark, log, tmp_path):
    narrow = Request(limit=2, rendered_only=True, countries=("GB", "US"))
    configured = [
        *[(n, registry()[n], ["hourly", "daily"], Request(limit=3)) for n in SIX],
        ("british", registry()["pageviews"], ["daily"], narrow), ("sections", registry()["searches"], ["daily"], Request(paths=("/search/", "/words/"), redirects=("308",))),
        ("beacons", registry()["beacon-events"], ["hourly", "daily"], ALL), ("errors", registry()["javascript-errors"], ["daily"], Request()), ("vitals", registry()["web-vitals"], ["daily"], ALL),
    ]
    scheduled = matrix(configured)
    busy = flooded(log, 90)
    spans = [*hours(START, START + DAY), *days(START, START + 2 * DAY)]
    store = SummaryStore(spark, str(tmp_path))
    windows = run(busy, store, scheduled, spans, now())
    for name, question, cadences, request in configured:
        own = [w for w in spans if w.granularity in cadences]
        assert windows[name] == own
        want = compute(busy, question, request, own)
        assert rows(store.read(name, own).drop("computed_at").select(*want.columns)) == rows(want), name
        assert store.ledger(name).count() == len(own)
    assert columns_of(scheduled[-1]) == ["vital"] and len(spark.read.parquet(f"{store.root}/rows").select("run").distinct().collect()) == 2


def test_refusals_of_the_matrix(log):
    q = registry()["pageviews"]
    with pytest.raises(ValueError, match="several ways"):
        compute_matrix(log, [Scheduled("a", q, "daily", Request()), Scheduled("a", q, "hourly", ALL)], days(START, START + DAY))
    with pytest.raises(ValueError, match="no sums"):
        compute_matrix(log, [Scheduled("v", registry()["web-vitals"], "daily", ALL)], days(START, START + DAY))
    with pytest.raises(ValueError, match="no windows"):
        compute_matrix(log, [Scheduled("a", q, "daily", ALL)], [])
    assert WINDOW == ["granularity", "window_start"]
