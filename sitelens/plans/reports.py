"""Report sections and documents (R7 to R14): how each value was made, and how exact that leaves it."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.merge import adjacency, answer_from_windows
from sitelens.operators.questions import Question
from sitelens.plans.calendar import previous
from sitelens.plans.identity import identity
from sitelens.plans.request import Request, TimeRange
from sitelens.plans.windows import SIZES, WINDOW, Span, as_rows
from sitelens.sources.once import create_once
from sitelens.sources.stores import SummaryStore

VERSION = 1


def calculation(question: Question) -> str:
    """Summaries only where everything adds up and nothing is computed again; else one query over the period."""
    return "summaries" if question.added and not question.recomputed else "period-query"


def rule(question: Question) -> str:
    if question.percentile:
        return "percentile"
    return "ranked" if question.ranked else "additive"


def period_answer(log: DataFrame, question: Question, request: Request, start_ms: int, end_ms: int) -> DataFrame:
    """The question over exactly one period."""
    return question.answer(log, replace(request, span=TimeRange(start_ms, end_ms - 1)))


def summarised(rows: DataFrame, wanted: DataFrame, question: Question, version: int = VERSION, limit: int | None = None) -> DataFrame:
    """The stored windows of a period, added up (R9); a ranking is cut to its limit.

    Only the question's own rows are taken: of this version and name where these are stored, with its keys, and with its added columns as numbers.
    Others are as good as absent, which leaves their section incomplete.
    """
    for column, value in (("version", version), ("question", question.name)):
        if column in rows.columns:
            rows = rows.filter(F.col(column).eqNullSafe(F.lit(value))).drop(column)
    kinds = dict(rows.dtypes)
    unfit = [c for c in (*question.keys, *question.added) if c not in kinds or (c in question.added and kinds[c] in ("boolean", "binary", "date", "timestamp"))]
    if unfit:
        fit = [F.lit(None).cast("string").alias(c) if c in question.keys else F.lit(0).cast("long").alias(c) for c in (*question.keys, *question.added)]
        rows = rows.select(*WINDOW, *fit).limit(0)
    chosen = rows.join(wanted.select(*WINDOW).distinct(), WINDOW, "left_semi")
    return answer_from_windows(chosen, question, 2, limit)


def stored_section(store: SummaryStore, name: str, question: Question, request: Request, spans: Sequence[Span]) -> tuple[DataFrame | None, DataFrame]:
    """A section out of the store (R9): its rows, none without any source, and the windows they come from (section, from, until).

    Windows that were narrowed otherwise, cut shorter, of another length, or with other columns than the first of them are left out, and judged as gaps.
    """
    own = identity(question, request)
    fits, columns = [], None
    for entry in sorted(store.entries(name, spans), key=lambda e: (e["start"], e["granularity"])):
        whole = (entry["window_end"] - entry["window_start"]).total_seconds() * 1000 == SIZES[entry["granularity"]]
        same = entry["digest"] == own["digest"] and entry["limit"] == own["limit"]
        if whole and same and columns in (None, entry["columns"]):
            columns = entry["columns"]
            fits.append(entry)
    frame = store.spark.createDataFrame([(name, e["start"], e["start"] + SIZES[e["granularity"]]) for e in fits], "section string, a long, b long")
    sources = frame.select("section", F.timestamp_millis("a").alias("from"), F.timestamp_millis("b").alias("until"))
    if not fits:
        return None, sources
    rows = store.of_entries(name, fits).drop("computed_at")
    if len(fits) == 1 or not question.added:
        return answer_from_windows(rows, question, 1, request.limit), sources
    return summarised(rows, as_rows(store.spark, [Span(e["start"], e["granularity"]) for e in fits]), question, limit=request.limit if question.ranked else None), sources


def judged_sections(windows: DataFrame, sections: DataFrame) -> DataFrame:
    """Accuracy, composition and reason of each section.

    ``sections``: section, rule (missing, additive, ranked, visitor-count, percentile), calculation, period_from, period_until.
    ``windows``: section, from, until of the sources found.
    """
    spans = adjacency(windows, ["section"])
    rows = sections.join(spans, "section", "left")
    complete = F.coalesce(F.col("adjacent") & (F.col("first") == F.col("period_from")) & (F.col("last") == F.col("period_until")), F.lit(False))
    missing, query, single = F.col("rule") == "missing", F.col("calculation") == "period-query", F.col("n") == 1
    accuracy = (
        F.when(missing | ~F.col("complete"), "unavailable").when(query | single, "exact").when(F.col("rule") == "additive", "exact")
        .when(F.col("rule") == "ranked", "approximate").otherwise("unavailable")
    )
    composition = (
        F.when(missing | ~F.col("complete"), "none").when(query, "period-query").when(single, "single-summary").when(F.col("rule") == "additive", "additive")
        .when(F.col("rule") == "ranked", "ranked-summaries").otherwise("none")
    )
    reason = (
        F.when(missing, "missing-rollup").when(~F.col("complete"), "incomplete-source").when(F.col("accuracy") != "unavailable", F.lit(None))
        .when(F.col("rule") == "visitor-count", "visitor-counts-do-not-compose").otherwise("percentiles-do-not-compose")
    )
    rows = rows.withColumn("complete", complete).withColumn("accuracy", accuracy).withColumn("composition", composition).withColumn("reason", reason)
    return rows.withColumn("summaries", F.coalesce(F.when(query, 0).otherwise(F.col("n")), F.lit(0)).cast("long")).drop("n", "adjacent")


def coverage(judged: DataFrame) -> DataFrame:
    """Span and completeness of a document over its sections with sources (R13); no row values without any."""
    have = judged.filter("first IS NOT NULL")
    return have.agg(F.min("first").alias("from"), F.max("last").alias("until"), F.bool_and("complete").alias("complete"), F.count(F.lit(1)).alias("sections"))


def computed(sections: dict[str, Callable[[], DataFrame]], until_ms: int, now_ms: int) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Values of the sections of a period that has closed, and the errors of those that failed; one failure leaves the others."""
    if until_ms > now_ms:
        raise ValueError("the period has not closed yet")
    values: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for section, answer in sections.items():
        try:
            values[section] = answer()
        except (ValueError, AnalysisException) as error:
            errors[section] = str(error)
    return values, errors


def document(judged: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """One row per section with its value as JSON (R14); a section without a value has null.

    Values are answers of bounded size: rankings keep their limit in a report.
    """
    out = None
    for section, rows in values.items():
        order = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])))
        own = rows.agg(F.to_json(order, {"ignoreNullFields": "false"}).alias("value")).withColumn("section", F.lit(section))
        out = own if out is None else out.unionByName(own)
    return judged.join(out, "section", "left") if out is not None else judged.withColumn("value", F.lit(None).cast("string"))


def report_key(zone: str, week_start: str, unit, starts_on):
    """Where a document lies: zone, unit, week start (for weeks) and first date."""
    week = F.when(unit == "week", F.lit(f"/week-starts-{week_start}")).otherwise("")
    return F.concat(F.lit(zone.replace("/", "-") + "/"), unit, week, F.lit("/"), starts_on.cast("string"))


def manifest(closing: DataFrame, zone: str, week_start: str = "monday") -> DataFrame:
    """For each closed day the periods that end with it, longest first, with the keys of each and of the one before (C11).

    ``closing`` comes from calendar.closing_with_days(); a unit stands once per day.
    """
    once = closing.dropDuplicates(["day", "unit"])
    rows = previous(once, zone, week_start)
    return rows.select(
        "day", "unit", "rank", report_key(zone, week_start, F.col("unit"), F.col("starts_on")).alias("current_key"),
        report_key(zone, week_start, F.col("unit"), F.col("previous_starts_on")).alias("previous_key"),
    )


def announce(spark: SparkSession, root: str, manifests: DataFrame, zone: str, units: Sequence[str], created_at: str) -> dict[str, str]:
    """Write the manifest of each closed day once, if any of ``units`` closes with it: key to "written" or "already there" (C11).

    ``manifests`` comes from manifest(): a few rows for each day that a run closes.
    """
    days: dict[str, list[dict[str, str]]] = {}
    for r in manifests.filter(F.col("unit").isin(*units)).orderBy("day", "rank").collect():
        days.setdefault(str(r["day"]), []).append({"unit": r["unit"], "current": r["current_key"], "previous": r["previous_key"]})
    said = {}
    for day, reports_ in days.items():
        key = f"notifications/{zone.replace('/', '-')}/{day}.json"
        text = json.dumps({"version": VERSION, "zone": zone, "day": day, "created_at": created_at, "reports": reports_})
        said[key] = "written" if create_once(spark, f"{root.rstrip('/')}/{key}", text) else "already there"
    return said


def require_preceding(current: DataFrame, before: DataFrame) -> None:
    """Two periods compare only if one ends where the other begins, unit for unit."""
    pairs = current.alias("c").join(before.alias("p"), "unit", "full_outer")
    if pairs.filter(~F.col("p.until").eqNullSafe(F.col("c.from"))).limit(1).count():
        raise ValueError("a period compares with the one immediately before it")
