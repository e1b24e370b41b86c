"""The questions (A1 to A15) and the registry of them and of custom ones.

A question's body takes the log, a request and window columns. With no window columns it answers over the request's
span; with some (see plans.windows) the same body answers for every window in one job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import events
from sitelens.functions.requests import BEACON_PATH, browser_family, device_class, is_page_view, matched_prefix, on_beacon_path, under_any
from sitelens.functions.text import any_of, count_where, hour_number, is_number, measured, parameter, percent, referrer_host
from sitelens.functions.visitors import PAIR, digest, has_address
from sitelens.operators.rows import rows_for, top, with_rendered_flag
from sitelens.plans.request import Request

#: One sender counts for at most so many events of a kind in an hour.
EVENT_CAP = 60

Body = Callable[[DataFrame, Request, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Tally:
    """Counts as sums over single rows, so that many questions share one pass over the log and sums of parts are sums of the whole.

    ``where``: rows that count, besides the request's own narrowings. ``keys``: what they are counted by, as text. ``measures``: what each adds.
    ``events``: over events instead of rows. ``capped``: a sum counts for at most ``cap`` within these further keys.
    """

    where: Callable[[Request], Column]
    keys: Callable[[Request], list[Column]]
    measures: Callable[[Request], list[Column]]
    events: bool = False
    capped: Callable[[Request], list[Column]] | None = None
    cap: int | None = None


@dataclass(frozen=True)
class Question:
    name: str
    body: Body
    keys: tuple[str, ...] = ()
    #: Columns that add up over windows; none: windows never combine.
    added: tuple[str, ...] = ()
    #: Columns computed again from the added ones.
    recomputed: dict[str, Callable[[], Column]] = field(default_factory=dict)
    ranked: bool = True
    percentile: bool = False
    counts_visitors: bool = False
    needs_address: bool = False
    #: Narrowings that only some questions read.
    reads: tuple[str, ...] = ()
    #: The same counts as sums over rows, where the question is no more than that.
    tally: Tally | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9]*(-[a-z0-9]+)*", self.name):
            raise ValueError(f"{self.name!r} is no question name")

    def answer(self, log: DataFrame, request: Request = Request(), by: Sequence[str] = ()) -> DataFrame:  # noqa: B008
        if self.needs_address and "c_ip" not in log.columns:
            raise ValueError(f"{self.name} needs the viewer's address, which this log leaves out")
        return self.body(log, request, tuple(by))

    def without_visitors(self) -> Question:
        return replace(self, counts_visitors=False)


def _ranked(rows: DataFrame, keys: list[str], measures: dict[str, Column], order: str, request: Request, by: Sequence[str]) -> DataFrame:
    counted = rows.groupBy(*by, *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return top(counted, order, keys, request.limit, by)


def _rows() -> Column:
    return F.count(F.lit(1))


def _pageviews(log, request, by):
    return _ranked(rows_for(log, request, [is_page_view()], by), ["path"], {"views": _rows()}, "views", request, by)


def _referrers(log, request, by):
    rows = rows_for(log, request, [is_page_view(), F.col("cs_referer") != "-"], by)
    rows = rows.withColumn("referrer", referrer_host(F.col("cs_referer"))).filter(F.col("referrer") != F.col("x_host_header"))
    return _ranked(rows, ["referrer"], {"views": _rows()}, "views", request, by)


def _browsers(log, request, by):
    rows = rows_for(log, request, [is_page_view()], by)
    agent = F.col("cs_user_agent")
    rows = rows.withColumns({"browser": browser_family(agent), "device": device_class(agent)})
    return _ranked(rows, ["browser", "device"], {"views": _rows()}, "views", request, by)


def _status_codes(log, request, by):
    rows = rows_for(log, request, [~on_beacon_path()], by).withColumn("status", F.col("sc_status"))
    return _ranked(rows, ["status"], {"responses": _rows()}, "responses", request, by)


def _cache_hit_ratio(log, request, by):
    result = F.col("x_edge_result_type")
    hits, misses = count_where(result.isin("Hit", "RefreshHit")), count_where(result == "Miss")
    rows = rows_for(log, request, [], by)
    return rows.groupBy(*by).agg(hits.alias("hits"), misses.alias("misses"), percent(hits, hits + misses).alias("hit_percent"))


def _searches(log, request, by):
    query = F.col("cs_uri_query")
    rows = rows_for(log, request, [F.col("cs_method") == "GET", query != "-"], by)
    rows = rows.withColumn("term", parameter(query, request.param)).filter(F.col("term") != "")
    keys = ["term"]
    if len(request.paths or ()) > 1:
        rows = rows.withColumn("section", matched_prefix(F.col("path"), request.paths))
        keys.append("section")
    measures = {"searches": _rows(), "redirected": count_where(any_of(F.col("sc_status"), request.redirects))}
    return _ranked(rows, keys, measures, "searches", request, by)


def _event_rows(log, request, by, narrowed=True):
    rows = rows_for(log, request.on_beacon_path() if narrowed else request, [], by)
    return events.with_events(rows).filter(events.is_event())


def _beacon_events(log, request, by):
    rows = _event_rows(log, request, by, narrowed=False).withColumn("hour_number", hour_number(F.col("ts_ms")))
    sent = rows.groupBy(*by, "page", "event", *PAIR, "hour_number").agg(F.least(_rows(), F.lit(EVENT_CAP)).alias("n"))
    return _ranked(sent, ["page", "event"], {"events": F.sum("n")}, "events", request, by)


def _beacon_totals(log, request, by):
    rows = _event_rows(log, request, by).filter(~F.col("event").isin(*events.VITALS, *events.ERRORS) & (F.col("value") != ""))
    rows = rows.select(*by, "event", *PAIR, "timestamp_ms", "value", hour_number(F.col("ts_ms")).alias("hour_number"))
    seen = F.row_number().over(Window.partitionBy(*by, "event", *PAIR, "hour_number").orderBy("timestamp_ms", "value"))
    rows = rows.withColumn("seen", seen).filter(F.col("seen") <= EVENT_CAP).withColumn("number", measured(F.col("value")))
    measures = {"events": _rows(), "total": F.coalesce(F.sum("number"), F.lit(0.0))}
    return _ranked(rows, ["event"], measures, "total", request, by)


def web_vitals(exact: bool = False) -> Body:
    """The 75th percentile: approximate by default, exact where one group's values fit into a task."""

    def body(log, request, by):
        rows = _event_rows(log, request, by).filter(F.col("event").isin(*events.VITALS) & is_number(F.col("value")))
        rows = rows.withColumn("number", measured(F.col("value"))).filter(F.col("number") >= 0)
        p75 = F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY number)") if exact else F.percentile_approx("number", 0.75, 10_000)
        answer = rows.groupBy(*by, F.col("event").alias("vital")).agg(p75.cast("double").alias("p75"), _rows().alias("samples"))
        return answer if by else answer.orderBy("vital")

    return body


def _javascript_errors(log, request, by):
    rows = _event_rows(log, request, by).filter(F.col("event").isin(*events.ERRORS))
    return _ranked(rows, ["page", "message"], {"errors": _rows()}, "errors", request, by)


def _conversion_answer(rows: DataFrame, viewed: Column, converted: Column, by: Sequence[str], by_device: bool) -> DataFrame:
    """Per visitor whether they viewed and converted, then visitors counted."""
    keys = [*by, *(["device"] if by_device else [])]
    if by_device:
        rows = rows.withColumn("device", device_class(F.col("cs_user_agent")))
    each = rows.groupBy(*keys, *PAIR).agg(count_where(viewed).alias("v"), count_where(converted).alias("c"))
    both, all_ = count_where((F.col("c") > 0) & (F.col("v") > 0)), count_where(F.col("v") > 0)
    measures = [both.alias("converted"), all_.alias("visitors"), percent(both, all_).alias("converted_percent")]
    answer = each.groupBy(*keys).agg(*measures) if keys else each.agg(*measures)
    return answer.orderBy("device") if by_device and not by else answer


def conversion_on_event(event: str) -> Question:
    """Visitors that viewed a page, and those of them that sent an event; the beacon path is never a page."""

    def body(log, request, by):
        beacon = (request.paths or (BEACON_PATH,))[0]
        rows = events.with_events(rows_for(log, replace(request, paths=None), [has_address()], by))
        viewed = is_page_view() & ~on_beacon_path(beacon)
        converted = events.is_event() & on_beacon_path(beacon) & (F.col("event") == event)
        return _conversion_answer(rows.filter(viewed | converted), viewed, converted, by, False)

    return Question(f"conversions-{event}", body, ranked=False, needs_address=True)


def conversion_on_path(prefix: str, method: str | None = None, statuses: Sequence[str] | None = None, by_device: bool = False) -> Question:
    """The same with a request under a path (by method and statuses, if named) as the conversion."""

    def body(log, request, by):
        rows = rows_for(log, replace(request, paths=None), [has_address()], by)
        converted = under_any(F.col("path"), [prefix])
        if method:
            converted &= F.col("cs_method") == method.upper()
        if statuses is not None:
            converted &= any_of(F.col("sc_status"), statuses)
        viewed = is_page_view() & ~on_beacon_path()
        return _conversion_answer(rows.filter(viewed | converted), viewed, converted, by, by_device)

    slug = re.sub(r"[^a-z0-9]+", "-", prefix.lower()).strip("-") or "root"
    return Question(f"conversions-{slug}" + ("-by-device" if by_device else ""), body, keys=("device",) if by_device else (), ranked=False, needs_address=True)


def _visits(log: DataFrame, request: Request, salts: DataFrame, by: Sequence[str], split: bool, once: bool = True) -> DataFrame:
    """The digests of the visitors of page views, by window; ``once`` if rows are made distinct before they are salted."""
    outer = replace(request, rendered_only=False) if split else request
    rows = rows_for(log, outer, [is_page_view(), has_address()], by)
    if split:
        rows = with_rendered_flag(rows, log, request.beacon_path, by)
    else:
        rows = rows.withColumn("rendered", F.lit(True))
    rows = rows.withColumn("day_text", F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int")).cast("string")).select(*by, *PAIR, "rendered", "day_text")
    rows = rows.distinct() if once else rows
    if "day" in salts.columns:
        rows = rows.join(salts.withColumnRenamed("day", "day_text"), "day_text")
    else:
        rows = rows.withColumn("salt", F.lit(salts.first()["salt"]))
    return rows.select(*by, digest(F.col("salt")).alias("id"), "rendered").filter(F.col("id").isNotNull())


def visitors(log: DataFrame, request: Request, salts: DataFrame, by: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Exact distinct visitors of page views (A7); ``split`` counts unrendered ones apart.

    ``salts`` has one row per ``day`` (yyyy-mm-dd), or a single row without that column for a whole period.
    Digests are made distinct before they are counted, so no row is expanded.
    """
    ids = _visits(log, request, salts, by, split)
    ids = ids.groupBy(*by, "id").agg(F.max(F.col("rendered").cast("int")).alias("r"), F.min(F.col("rendered").cast("int")).alias("u"))
    measures = [count_where(F.col("r") == 1).alias("distinct_visitors")]
    if split:
        measures.append(count_where(F.col("u") == 0).alias("unrendered"))
    answer = ids.groupBy(*by).agg(*measures) if by else ids.agg(*measures)
    return answer.na.fill(0, [c for c in ("distinct_visitors", "unrendered") if c in answer.columns])


#: A sketch of 2^14 registers: 12 KB at most, and a relative standard error below 1 %.
SKETCH_BITS = 14


def visitor_sketches(log: DataFrame, request: Request, salts: DataFrame, by: Sequence[str]) -> DataFrame:
    """By window, a sketch of the visitors of page views, from which approximate counts of any windows together follow (A7, on request only).

    Sketches of parts are merged before the shuffle, so a window costs one sketch a task, however many visitors it has.
    """
    return _visits(log, request, salts, by, False, once=False).groupBy(*by).agg(F.hll_sketch_agg("id", SKETCH_BITS).alias("sketch"))


def approximate_visitors(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Approximate distinct visitors of windows together, marked as such, with the relative standard error of the sketch."""
    merged = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long"))
    measures = [merged.alias("approximate_visitors"), F.lit(1.04 / 2 ** (SKETCH_BITS / 2)).alias("relative_error")]
    return sketches.groupBy(*by).agg(*measures) if by else sketches.agg(*measures)


def _hit_percent() -> Column:
    return percent(F.col("hits"), F.col("hits") + F.col("misses"))


def _one(request: Request) -> list[Column]:
    return [F.lit(1)]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _referred() -> Column:
    return referrer_host(F.col("cs_referer"))


def _searched(request: Request) -> Column:
    query = F.col("cs_uri_query")
    return (F.col("cs_method") == "GET") & (query != "-") & (parameter(query, request.param) != "")


def _term(request: Request) -> list[Column]:
    several = len(request.paths or ()) > 1
    return [parameter(F.col("cs_uri_query"), request.param), *([matched_prefix(F.col("path"), request.paths)] if several else [])]


def _happened(request: Request) -> Column:
    return events.is_event()


def _failed(request: Request) -> Column:
    beacon = under_any(F.col("path"), request.on_beacon_path().paths) if request.paths is None else F.lit(True)
    return events.is_event() & F.col("event").isin(*events.ERRORS) & beacon


_RESULT = "x_edge_result_type"
_TALLIES = {
    "pageviews": Tally(lambda r: is_page_view(), lambda r: [F.col("path")], _one),
    "referrers": Tally(lambda r: is_page_view() & (F.col("cs_referer") != "-") & (_referred() != F.col("x_host_header")), lambda r: [_referred()], _one),
    "browsers": Tally(lambda r: is_page_view(), lambda r: [browser_family(F.col("cs_user_agent")), device_class(F.col("cs_user_agent"))], _one),
    "status-codes": Tally(lambda r: ~on_beacon_path(), lambda r: [F.col("sc_status")], _one),
    "cache-hit-ratio": Tally(lambda r: F.lit(True), lambda r: [], lambda r: [_flag(F.col(_RESULT).isin("Hit", "RefreshHit")), _flag(F.col(_RESULT) == "Miss")]),
    "searches": Tally(_searched, _term, lambda r: [F.lit(1), _flag(any_of(F.col("sc_status"), r.redirects))]),
    "beacon-events": Tally(
        _happened, lambda r: [F.col("page"), F.col("event")], _one, events=True, cap=EVENT_CAP,
        capped=lambda r: [F.col("c_ip"), F.col("cs_user_agent"), hour_number(F.col("ts_ms")).cast("string")],
    ),
    "javascript-errors": Tally(_failed, lambda r: [F.col("page"), F.col("message")], _one, events=True),
}

DEFAULT_QUESTIONS = [
    Question("pageviews", _pageviews, ("path",), ("views",), counts_visitors=True),
    Question("referrers", _referrers, ("referrer",), ("views",)),
    Question("browsers", _browsers, ("browser", "device"), ("views",)),
    Question("status-codes", _status_codes, ("status",), ("responses",)),
    Question("cache-hit-ratio", _cache_hit_ratio, (), ("hits", "misses"), {"hit_percent": _hit_percent}, ranked=False),
    Question("searches", _searches, ("term",), ("searches", "redirected"), reads=("param", "redirects")),
    Question("beacon-events", _beacon_events, ("page", "event"), ("events",), needs_address=True),
    Question("beacon-totals", _beacon_totals, ("event",), ("total", "events"), needs_address=True),
    Question("web-vitals", web_vitals(), ("vital",), ranked=False, percentile=True),
    Question("javascript-errors", _javascript_errors, ("page", "message"), ("errors",)),
]
DEFAULT_QUESTIONS = [replace(q, tally=_TALLIES.get(q.name)) for q in DEFAULT_QUESTIONS]


class Registry:
    """Questions by name; custom ones are callables over the shared row filter."""

    def __init__(self, questions: Sequence[Question] = ()) -> None:
        self._questions: dict[str, Question] = {}
        for q in questions:
            self.add(q)

    def add(self, question: Question) -> Question:
        if question.name in self._questions:
            raise ValueError(f"{question.name} is registered already")
        self._questions[question.name] = question
        return question

    def __getitem__(self, name: str) -> Question:
        return self._questions[name]

    def __iter__(self):
        return iter(self._questions.values())


def registry() -> Registry:
    return Registry(DEFAULT_QUESTIONS)
