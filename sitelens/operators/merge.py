"""Combining stored windows (M2 to M10): what adds up, what is recomputed, and what never combines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.questions import Question
from sitelens.operators.rows import reranked, top
from sitelens.plans.identity import NARROWINGS
from sitelens.plans.windows import WINDOW


def _number(column: str, kind: str):
    target = "double" if kind in ("double", "float") or kind.startswith("decimal") else "long"
    return F.coalesce(F.col(column).try_cast(target), F.lit(0).cast(target))


def added_up(rows: DataFrame, question: Question) -> DataFrame:
    """Sums over windows by key; null keys are one key, cells that are no numbers count 0; ratios are computed again."""
    kinds = dict(rows.dtypes)
    keys = [c for c in rows.columns if c not in question.added and c not in question.recomputed and c not in WINDOW]
    sums = [F.sum(_number(c, kinds[c])).alias(c) for c in question.added]
    merged = rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)
    return merged.withColumns({c: make() for c, make in question.recomputed.items()}) if question.recomputed else merged


def answer_from_windows(rows: DataFrame, question: Question, n_windows: int, limit: int | None = None) -> DataFrame:
    """One window answers as it is stored; several only where the question adds up."""
    keys = list(question.keys)
    if n_windows == 1:
        rows = rows.drop(*WINDOW)
        return top(rows, question.added[0], keys, limit) if question.ranked and question.added else rows
    if not question.added:
        raise ValueError(f"{question.name} does not combine over windows; ask for one window or a fresh answer")
    merged = added_up(rows, question)
    return reranked(merged, question.added, keys, limit) if question.ranked else merged


def gaps(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: ``present``, ``skipped`` (missing at the edges) and ``holes`` (missing between present ones)."""
    have = ledger.select(*WINDOW).distinct().withColumn("here", F.lit(1))
    marked = wanted.distinct().join(have, WINDOW, "left")
    # Only the outermost present windows are needed to tell an edge from a hole; they are one row.
    ends = marked.filter("here = 1").agg(F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    inside = marked.join(ends, (F.col("window_start") > F.col("first")) & (F.col("window_start") < F.col("last")), "left")
    present = F.col("here").isNotNull()
    hole = ~present & F.col("first").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return inside.agg(count(present).alias("present"), count(~present & ~hole).alias("skipped"), count(hole).alias("holes"))


def covering_windows(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """The wanted windows that can be read; a missing day stands for its 24 hours if all of them are there (M8)."""
    have = ledger.select(*WINDOW).distinct()
    found = wanted.join(have, WINDOW, "left_semi")
    lacking = wanted.filter("granularity = 'daily'").join(have, WINDOW, "left_anti").select(F.col("window_start").alias("day"))
    hours = have.filter("granularity = 'hourly'").withColumn("day", F.timestamp_seconds(F.unix_seconds("window_start") - F.pmod(F.unix_seconds("window_start"), F.lit(86_400))))
    whole = hours.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter("n = 24").join(lacking, "day", "left_semi")
    return found.unionByName(hours.join(whole, "day", "left_semi").select(*WINDOW))


def require_no_holes(counts: DataFrame) -> None:
    row = counts.first()
    if row["holes"]:
        raise ValueError(f"{row['holes']} windows are missing between stored ones")
    if not row["present"]:
        raise ValueError("no stored window covers any of the range")


def adopted(ledger: DataFrame, asked: dict[str, str | None]) -> DataFrame:
    """Ledger rows whose question matches (M9), of a ledger with any of the narrowings as columns.

    Named narrowings must be equal in every window; those not named are adopted if all windows agree on them. A stored limit must be at
    least the asked one; with none asked the smallest stored one holds (column ``adopted_limit``, null where no window keeps one). Windows that do not
    match are refused, not left out: without them the answer would lack a part of the range. Narrowings that no window stores are none.
    """
    stored = [n for n in NARROWINGS if n in ledger.columns]
    differs = F.lit(False)
    for name, value in asked.items():
        if name in stored:
            differs = differs | ~F.col(name).eqNullSafe(F.lit(value))
        elif name != "limit" and value is not None:
            raise ValueError(f"no stored window was narrowed by {name}")
    limit = F.col("limit").cast("int") if "limit" in ledger.columns else F.lit(None).cast("int")
    if asked.get("limit") is not None:
        differs = differs | F.coalesce(limit < int(asked["limit"]), F.lit(False))
    free = [n for n in stored if n not in asked]
    # One pass over the ledger: does any differ, do the free ones agree, which is the smallest limit.
    kinds = F.count_distinct(F.struct(*free)) if free else F.lit(1)
    told = ledger.agg(F.coalesce(F.bool_or(differs), F.lit(False)).alias("differs"), kinds.alias("kinds"), F.min(limit).alias("least")).first()
    if told["differs"]:
        raise ValueError("stored windows were narrowed otherwise, or by a smaller limit, than is asked")
    if told["kinds"] > 1:
        raise ValueError("stored windows differ in what was not asked for; name it")
    return ledger.withColumn("adopted_limit", F.lit(asked["limit"] if asked.get("limit") is not None else told["least"]).cast("int"))


def freshness(ledger: DataFrame) -> DataFrame:
    """Newest computation, first start and last end of the windows used, per granularity."""
    return ledger.groupBy("granularity").agg(
        F.max("computed_at").alias("computed_at"), F.min("window_start").alias("from"), F.max("window_end").alias("until"), F.count(F.lit(1)).alias("windows")
    )


def adjacency(windows: DataFrame, by: list[str]) -> DataFrame:
    """Per section, whether its windows follow each other without a gap: columns first, last, n, adjacent."""
    before = F.lag("until").over(Window.partitionBy(*by).orderBy("from", "until"))
    follows = windows.withColumn("follows", F.coalesce(before == F.col("from"), F.lit(True)))
    return follows.groupBy(*by).agg(
        F.min("from").alias("first"), F.max_by("until", F.struct("from", "until")).alias("last"), F.count(F.lit(1)).alias("n"), F.bool_and("follows").alias("adjacent")
    )
