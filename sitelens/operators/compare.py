"""Comparing two periods."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    column: str
    unit: str = "count"
    measure: str = "count"  # count, ratio or percentile
    preference: str = "neutral"  # or higher-is-better, lower-is-better
    #: Units by the value of a key column: (column, {value: unit}); ``unit`` is the fallback.
    unit_by: tuple[str, dict[str, str]] | None = None


@dataclass(frozen=True)
class Definition:
    question: str
    metrics: tuple[Metric, ...]
    ranked: bool = True
    value_type: str = "rows"
    keys: tuple[str, ...] = field(default=())


_VITAL_UNITS = ("vital", {"lcp": "milliseconds", "cls": "score", "fcp": "milliseconds", "ttfb": "milliseconds"})
# What is compared for each question, with its unit and preference.
#: They hold unless a caller brings a definition of the same question and value type.
DEFINITIONS = [
    Definition("pageviews", (Metric("views", "pageviews"),)),
    Definition("pageviews", (Metric("distinct", "visitors"),), ranked=False, value_type="visitor-count"),
    Definition("referrers", (Metric("views", "pageviews"),)),
    Definition("browsers", (Metric("views", "pageviews"),)),
    Definition("status-codes", (Metric("responses", "responses"),)),
    Definition("cache-hit-ratio", (Metric("hits", "requests"), Metric("misses", "requests"), Metric("hit_percent", "percent", "ratio", "higher-is-better")), ranked=False),
    Definition("searches", (Metric("searches", "searches"), Metric("redirected", "searches"))),
    Definition("javascript-errors", (Metric("errors", "errors"),)),
    Definition("web-vitals", (Metric("p75", "value", "percentile", "lower-is-better", _VITAL_UNITS), Metric("samples", "samples")), ranked=False),
]


def definitions(custom: list[Definition] = []) -> dict[tuple[str, str], Definition]:  # noqa: B006
    return {(d.question, d.value_type): d for d in [*DEFINITIONS, *custom]}


def as_table(spark: SparkSession, chosen: list[Definition]) -> DataFrame:
    """The definitions as a small dimension: one row per question and metric."""
    rows = [(d.question, d.value_type, d.ranked, m.column, m.measure, m.unit, m.preference) for d in chosen for m in d.metrics]
    return spark.createDataFrame(rows, "question string, value_type string, ranked boolean, metric string, measure string, unit string, preference string")


def _change(measure: str) -> Column:
    if measure == "ratio":
        return F.col("difference")
    return F.when(F.col("previous") != 0, 100 * F.col("difference") / F.abs("previous"))


def compared(current: DataFrame, previous: DataFrame, definition: Definition) -> DataFrame:
    """One row per key and metric: current, previous, difference, change, trend and assessment.

    A row that one side lacks is never zero: its comparison is unavailable, with the reason. Null keys match each other.
    """
    metrics = [m.column for m in definition.metrics]
    keys = [c for c in current.columns if c not in metrics]
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], *[F.col(m).try_cast("double").alias(f"{name}_{m}") for m in metrics], F.lit(True).alias(f"in_{name}"))
    c, p = side(current, "c"), side(previous, "p")
    same = reduce(lambda a, b: a & b, [F.col(f"c_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys], F.lit(True))
    joined = c.join(p, same, "full_outer") if keys else c.withColumn("one", F.lit(1)).join(p.withColumn("one", F.lit(1)), "one", "full_outer")
    both = F.col("in_c").isNotNull() & F.col("in_p").isNotNull()
    named = [F.when(F.col("in_c").isNotNull(), F.col(f"c_{k}")).otherwise(F.col(f"p_{k}")).alias(k) for k in keys]
    parts = []
    for m in definition.metrics:
        unit = F.lit(m.unit)
        if m.unit_by:
            table = F.create_map(*[F.lit(x) for pair in m.unit_by[1].items() for x in pair])
            unit = F.coalesce(F.try_element_at(table, F.coalesce(F.col(f"c_{m.unit_by[0]}"), F.col(f"p_{m.unit_by[0]}"))), unit)
        finite = lambda name: F.when(~F.isnan(name) & (F.abs(name) != float("inf")), F.col(name))
        parts.append(
            joined.select(
                *named, F.lit(m.column).alias("metric"), F.lit(m.measure).alias("measure"), unit.alias("unit"), F.lit(m.preference).alias("preference"),
                finite(f"c_{m.column}").alias("current"), finite(f"p_{m.column}").alias("previous"), both.alias("both"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    known = F.col("current").isNotNull() & F.col("previous").isNotNull()
    reason = F.when(known, F.lit(None)).when(~F.col("both"), "ranked-row-absent" if definition.ranked else "row-absent").otherwise("metric-value-unavailable")
    rows = rows.withColumn("reason", reason).withColumn("difference", F.col("current") - F.col("previous"))
    change = F.when(F.col("measure") == "ratio", F.col("difference")).otherwise(_change("count"))
    up = F.col("difference") > 0
    better = F.col("preference") == "higher-is-better"
    trend = F.when(F.col("difference").isNull(), F.lit(None)).when(up, "increase").when(F.col("difference") < 0, "decrease").otherwise("unchanged")
    assessment = (
        F.when(F.col("trend").isNull(), F.lit(None)).when(F.col("trend") == "unchanged", "unchanged").when(F.col("preference") == "neutral", "unrated")
        .when(up == better, "improvement").otherwise("regression")
    )
    kind = F.when(known, F.when(F.col("measure") == "ratio", "percentage-points").otherwise("relative-percent"))
    note = F.when(known & (F.col("measure") != "ratio") & (F.col("previous") == 0), "zero-baseline")
    rows = rows.withColumn("change", change).withColumn("trend", trend).withColumn("assessment", assessment)
    return rows.withColumn("change_type", kind).withColumn("change_reason", note).drop("both")


def paired_sections(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sections (question, at, ...) by name and occurrence; current ones in order, then those only in the previous."""
    numbered = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("question").orderBy("at")))
    c = numbered(current).select("question", "nth", F.col("at").alias("current_at"))
    p = numbered(previous).select("question", "nth", F.col("at").alias("previous_at"))
    return c.join(p, ["question", "nth"], "full_outer")


def comparability(pairs: DataFrame) -> DataFrame:
    """The first reason why two sections don't compare, or null (C2), and whether a comparison is approximate.

    Columns: current_at, previous_at; and for each side ``c_`` and ``p_``: question_text, complete, accuracy, value_type, columns, defined;
    for the current one also metrics, the defined ones, which have to be among its columns.
    """
    c, p = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"p_{n}"))
    reason = (
        F.when(F.col("current_at").isNull() | F.col("previous_at").isNull(), "section-absent")
        .when(~c("question_text").eqNullSafe(p("question_text")), "question-mismatch")
        .when(~(c("complete") & p("complete")), "incomplete-source")
        .when((c("accuracy") == "unavailable") | (p("accuracy") == "unavailable"), "section-unavailable")
        .when(~c("value_type").eqNullSafe(p("value_type")), "value-type-mismatch")
        .when(~c("defined"), "unsupported-question")
        .when(~c("columns").eqNullSafe(p("columns")) | ~F.forall(c("metrics"), lambda m: F.array_contains(c("columns"), m)), "columns-mismatch")
    )
    close = F.when((c("accuracy") == "approximate") | (p("accuracy") == "approximate"), "approximate").otherwise("exact")
    return pairs.withColumn("reason", reason).withColumn("accuracy", F.when(reason.isNull(), close))


def _number(value: Column, decimals: int) -> Column:
    """A number rounded half up, without trailing zeros."""
    scaled = F.floor(value * 10**decimals + F.lit(0.5)) / 10**decimals
    text = F.format_string(f"%.{decimals}f", scaled)
    return F.when(scaled == F.floor(scaled), F.format_string("%d", scaled.cast("long"))).otherwise(F.regexp_replace(text, "0+$", ""))


def _metric_text() -> Column:
    """The words of a digest."""
    value = F.concat_ws(" ", "metric", _number(F.col("current"), 2), "unit")
    judged = F.when(F.col("assessment").isin("improvement", "regression"), F.concat(F.lit(", "), "assessment")).otherwise("")
    rounded = F.floor(F.col("change") * 10 + F.lit(0.5)) / 10
    change = F.concat(F.when(rounded > 0, "+").otherwise(""), _number(F.col("change"), 1))
    told = F.concat(change, F.when(F.col("change_type") == "percentage-points", " percentage points").otherwise("%"))
    told = F.when(F.col("reason").isNotNull(), "comparison unavailable").otherwise(
        F.concat(F.when(F.col("change").isNull(), "change unavailable from zero baseline").otherwise(told), judged)
    )
    return F.concat(value, F.lit(" ("), told, F.lit(")"))


def digest_rows(rows: DataFrame, keys: list[str], definition: Definition, limit: int = 5) -> DataFrame:
    """The first rows of a comparison as text (C10): place, line, and how many rows are left out.

    A line names the row's keys that are not null and all metrics that have a current value, in the order of the definition. Rows that only
    the previous period has are neither told nor counted. Rows stand as the comparison has them: ranked ones by the first metric, highest first, then by
    keys, others by keys. Without any row the only line says so.
    """
    order = {m.column: i for i, m in enumerate(definition.metrics)}
    nth = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("metric"))
    told = rows.filter(F.col("current").isNotNull()).withColumn("entry", F.struct(nth.alias("nth"), F.col("current"), _metric_text().alias("text")))
    lines = told.groupBy(*keys).agg(F.array_sort(F.collect_list("entry")).alias("entries"))  # an entry per metric at most
    label = F.concat_ws(", ", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys]) if keys else F.lit("")
    values = F.array_join(F.transform("entries", lambda e: e["text"]), ", ")
    lines = lines.select(*keys, F.col("entries")[0]["current"].alias("first"), F.when(label == "", values).otherwise(F.concat(label, F.lit(": "), values)).alias("line"))
    by = [*([F.col("first").desc_nulls_last()] if definition.ranked or not keys else []), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]]
    first = lines.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)))  # ``limit`` rows
    total = lines.agg(F.count(F.lit(1)).alias("n"))  # one row, also over none
    told = total.join(first, F.lit(True), "left")
    return told.select(F.coalesce("place", F.lit(1)).alias("place"), F.coalesce("line", F.lit("No rows.")).alias("line"), F.greatest(F.col("n") - limit, F.lit(0).cast("long")).alias("omitted"))
