"""Many questions at many cadences in one pass over the log.

Each row becomes one small entry per scheduled question whose rows it is among, with that question's keys and what it adds; entries are summed by
question, window and keys. The log is scanned once for all questions over rows and once for those over events, decoding is shared, and what
shows rendering is looked up once for each beacon path. Sums of parts of a log are sums of the log, which is what the stream keeps (see ``streaming``).

Questions that are more than such sums (percentiles, conversions, first events of an hour) are computed by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import events
from sitelens.functions.text import decoded_path
from sitelens.functions.visitors import PAIR
from sitelens.operators.rows import narrowed, rendered_pairs
from sitelens.plans.identity import identity
from sitelens.plans.windows import SIZES, WINDOW, Scheduled, Span, _only, compute, with_windows
from sitelens.sources.stores import SummaryStore

#: One row of sums: of a name, a window and keys; ``within`` holds the further keys of capped sums.
TALL = ["name", *WINDOW, "keys", "within", "measures"]


def by_name(scheduled: Sequence[Scheduled]) -> dict[str, list[Scheduled]]:
    """The entries of each configured name: one question and request, at several cadences."""
    named: dict[str, list[Scheduled]] = {}
    for s in scheduled:
        named.setdefault(s.name, []).append(s)
    for name, own in named.items():
        if any((s.question, s.request) != (own[0].question, own[0].request) for s in own):
            raise ValueError(f"configured in several ways: {name}")
    return named


def _entry(s: Scheduled, widest: int, cadences: Sequence[str]) -> Column:
    """What a row adds to one question, or null."""
    tally = s.question.tally
    keep = narrowed(s.request) & tally.where(s.request)
    if s.request.rendered_only:
        keep &= F.col(_flag_of(s.request.beacon_path))
    texts = lambda columns: F.array(*[c.cast("string") for c in columns]) if columns else F.array().cast("array<string>")
    measures = [c.cast("long") for c in tally.measures(s.request)]
    measures += [F.lit(0).cast("long")] * (widest - len(measures))
    within = tally.capped(s.request) if tally.capped else []
    made = F.struct(F.lit(s.name).alias("name"), texts(tally.keys(s.request)).alias("keys"), texts(within).alias("within"), F.array(*measures).alias("measures"))
    return F.when(keep & F.col("granularity").isin(*cadences), made)


def _flag_of(beacon_path: str) -> str:
    return f"rendered {beacon_path}"


def _rows_of(windowed: DataFrame, scheduled: Sequence[Scheduled]) -> DataFrame:
    """Rows by window with their path, and for each beacon path that is asked for whether their visitor showed rendering in the window."""
    rows = windowed.withColumn("path", decoded_path(F.col("cs_uri_stem")))
    for beacon in sorted({s.request.beacon_path for s in scheduled if s.request.rendered_only}):
        shown = rendered_pairs(windowed, beacon, WINDOW).withColumn(_flag_of(beacon), F.lit(True))
        rows = rows.join(shown, [*WINDOW, *PAIR], "left").withColumn(_flag_of(beacon), F.coalesce(_flag_of(beacon), F.lit(False)))
    return rows


def tallied(windowed: DataFrame, scheduled: Sequence[Scheduled]) -> DataFrame:
    """Sums (see ``TALL``) of rows that already have their windows, for questions with a tally."""
    named = by_name(scheduled)
    if lacking := [n for n, own in named.items() if own[0].question.tally is None]:
        raise ValueError(f"no sums over rows: {', '.join(lacking)}")
    if spanned := [n for n, own in named.items() if own[0].request.span is not None]:
        raise ValueError(f"windows have no other span: {', '.join(spanned)}")
    widest = max(len(own[0].question.added) for own in named.values())
    parts = []
    for over_events in (False, True):
        chosen = {n: own for n, own in named.items() if own[0].question.tally.events == over_events}
        if not chosen:
            continue
        rows = _rows_of(windowed, [s for own in chosen.values() for s in own])
        if over_events:
            beacon = F.col("cs_uri_query").isNotNull() & (F.col("cs_uri_query") != "-") & (F.col("cs_method") == "GET")
            rows = events.with_events(rows.filter(beacon))
        entries = F.array(*[_entry(own[0], widest, sorted({s.granularity for s in own})) for own in chosen.values()])
        each = rows.select(*WINDOW, F.explode(F.array_compact(entries)).alias("e")).select(*WINDOW, "e.*")
        sums = [F.sum(F.col("measures")[k]).alias(f"m{k}") for k in range(widest)]
        parts.append(each.groupBy("name", *WINDOW, "keys", "within").agg(*sums))
    summed = reduce(lambda a, b: a.unionByName(b), parts)
    return summed.withColumn("measures", F.array(*[f"m{k}" for k in range(widest)])).select(*TALL)


def added(parts: DataFrame, widest: int) -> DataFrame:
    """Sums of parts of a log."""
    sums = [F.sum(F.try_element_at("measures", F.lit(k + 1))).alias(f"m{k}") for k in range(widest)]
    summed = parts.groupBy("name", *WINDOW, "keys", "within").agg(*sums)
    return summed.withColumn("measures", F.array(*[F.coalesce(f"m{k}", F.lit(0).cast("long")) for k in range(widest)])).select(*TALL)


def finished(sums: DataFrame, scheduled: Sequence[Scheduled]) -> DataFrame:
    """Capped sums counted, rankings cut: name, window, keys, measures."""
    named = by_name(scheduled)
    widest = max(len(own[0].question.added) for own in named.values())
    if any(own[0].question.tally.capped for own in named.values()):
        caps = {n: own[0].question.tally.cap for n, own in named.items() if own[0].question.tally.capped}
        cap = reduce(lambda c, n: c.when(F.col("name") == n, caps[n]), caps, F.when(F.lit(False), F.lit(0)))
        counted = [F.sum(F.least(F.col("measures")[k], cap)).alias(f"m{k}") for k in range(widest)]  # least() skips a null cap
        sums = sums.groupBy("name", *WINDOW, "keys").agg(*counted).withColumn("measures", F.array(*[f"m{k}" for k in range(widest)]))
    limits = {n: own[0].request.limit for n, own in named.items() if own[0].question.ranked and own[0].request.limit is not None}
    if not limits:
        return sums.select("name", *WINDOW, "keys", "measures")
    most_keys = max(len(own[0].question.keys) for own in named.values()) + 1  # searches may have a section besides
    order = [F.col("measures")[0].desc(), *[F.try_element_at("keys", F.lit(k + 1)).asc_nulls_last() for k in range(most_keys)]]
    own_limit = reduce(lambda c, n: c.when(F.col("name") == n, limits[n]), limits, F.when(F.lit(False), F.lit(0)))
    placed = sums.withColumn("place", F.row_number().over(Window.partitionBy("name", *WINDOW).orderBy(*order)))
    if len(limits) == len(named):
        placed = placed.filter(F.col("place") <= max(limits.values()))  # a literal, so that rows go before the shuffle
    keep = own_limit.isNull() | (F.col("place") <= own_limit)
    return placed.filter(keep).select("name", *WINDOW, "keys", "measures")


def key_names(s: Scheduled) -> list[str]:
    """The key columns of an answer; several paths give searches a section."""
    section = s.question.name == "searches" and len(s.request.paths or ()) > 1
    return [*s.question.keys, *(["section"] if section else [])]


def side_by_side(finished_rows: DataFrame, scheduled: Sequence[Scheduled]) -> DataFrame:
    """Answers with the columns of all their questions, null where another question has them: name, window, ..."""
    columns: dict[str, list[tuple[str, Callable[[], Column]]]] = {}
    kinds: dict[str, str] = {}
    for name, own in by_name(scheduled).items():
        s = own[0]
        places = [(c, "string", lambda k=k: F.col("keys")[k]) for k, c in enumerate(key_names(s))]
        places += [(c, "bigint", lambda k=k: F.col("measures")[k]) for k, c in enumerate(s.question.added)]
        for column, kind, value in places:
            if kinds.setdefault(column, kind) != kind:
                raise ValueError(f"{column} is a key of one question and a measure of another")
            columns.setdefault(column, []).append((name, value))
    value = lambda uses: F.coalesce(*[F.when(F.col("name") == n, make()) for n, make in uses])
    wide = finished_rows.select("name", *WINDOW, *[value(uses).alias(c) for c, uses in columns.items()])
    again = {c: (n, make) for n, own in by_name(scheduled).items() for c, make in own[0].question.recomputed.items()}
    return wide.withColumns({c: F.when(F.col("name") == n, make()) for c, (n, make) in again.items()}) if again else wide


def columns_of(s: Scheduled) -> list[str]:
    return [*key_names(s), *s.question.added, *s.question.recomputed]


def compute_matrix(log: DataFrame, scheduled: Sequence[Scheduled], spans: Sequence[Span]) -> DataFrame:
    """The answers of all scheduled questions for all windows of their cadences, side by side."""
    if not spans:
        raise ValueError("no windows to compute")
    cadences = {s.granularity for s in scheduled}
    return side_by_side(finished(tallied(_only(log, [s for s in spans if s.granularity in cadences]), scheduled), scheduled), scheduled)


def run(log: DataFrame, store: SummaryStore, scheduled: Sequence[Scheduled], spans: Sequence[Span], computed_at: Column) -> Mapping[str, list[Span]]:
    """Compute and store all windows of all questions: those with a tally in one job, the others one by one. Returns what was stored, by name."""
    named = by_name(scheduled)
    windows = {n: [w for w in spans if w.granularity in {s.granularity for s in own}] for n, own in named.items()}
    moment = store.spark.range(1).select(computed_at.alias("t")).first()["t"]
    shared = {n: own for n, own in named.items() if own[0].question.tally is not None and windows[n]}
    if shared:
        chosen = [s for own in shared.values() for s in own]
        number = store.write_many(compute_matrix(log, chosen, spans), moment)
        ledgers = [store.ledger_rows(n, windows[n], moment, number, identity(own[0].question, own[0].request), columns_of(own[0])) for n, own in shared.items()]
        store.write_ledgers(ledgers)
    for name, own in named.items():
        if name not in shared and windows[name]:
            s = own[0]
            store.write(name, compute(log, s.question, s.request, windows[name]), windows[name], F.lit(moment), identity(s.question, s.request))
    return windows


def windows_of(batch: DataFrame, scheduled: Sequence[Scheduled]) -> DataFrame:
    """Rows of a log with the windows of all cadences."""
    return with_windows(batch, [g for g in SIZES if g in {s.granularity for s in scheduled}])
