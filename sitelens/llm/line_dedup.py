"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host when the pages of the host that contain it, divided by all
pages of the host, exceed a ratio. Each row of the input is one page.

* Lines are counted as (64-bit hash, 32-bit hash, length) per host, so texts are never shuffled;
  the count is pre-aggregated before its shuffle, so a hot host or line costs no more.
* At most (average distinct lines of a page / ratio) lines of one host can exceed the ratio, so
  the lines of a host fit into one array. The arrays are written as a table; Spark broadcasts it
  when its size is below the session's threshold and joins by sorting (with AQE's skew
  handling) when it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import cut

#: A line on more than this share of a host's pages goes.
RATIO = 0.1
#: Lines on fewer pages of a host stay, whatever their share is.
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("m"), F.length(line).alias("n"))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per host that has boilerplate: ``host``, ``bad`` (keys of its lines).

    Blank lines are never boilerplate. Null hosts form one host. An empty table gives no rows.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = rows.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    counts = (
        lines.filter(F.trim("line") != "")
        .select("host", _key(F.col("line")).alias("k"))
        .groupBy("host", "k")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    totals = totals.withColumnRenamed("host", "total_host")
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .filter(F.col("pages") / F.col("total") > ratio)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("k")).alias("bad"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counted: bool = False,
) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``; every row and column stays.

    ``counted`` appends ``n_lines`` and ``n_dropped`` (in place of columns so named). A null text
    stays null with no lines; an empty text is one blank line. A page of nothing but boilerplate
    gets an empty text. Repeated rows each count as a page; a null host is a host. An empty table stays empty.
    """
    bad = cut(boilerplate(pages, host, text, ratio, min_pages))
    bad = bad.select(F.col("host").alias("__llm_host"), F.col("bad").alias("__llm_bad"))
    joined = pages.join(bad, pages[host].eqNullSafe(bad["__llm_host"]), "left")
    lines = F.split(pages[text], "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__llm_bad"), _key(x)))
    cleaned = F.when(F.col("__llm_bad").isNull(), pages[text]).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(text) if c == text else pages[c] for c in pages.columns]
    if counted:
        n = F.when(pages[text].isNull(), 0).otherwise(F.size(lines)).cast("long")
        n_kept = F.when(F.col("__llm_bad").isNull() | pages[text].isNull(), n).otherwise(F.size(kept)).cast("long")
        columns = [c for c, name in zip(columns, pages.columns) if name not in ("n_lines", "n_dropped")]
        columns += [n.alias("n_lines"), (n - n_kept).alias("n_dropped")]
    return joined.select(*columns)


ORACLE_SQL = """
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT source, count(*) AS total FROM pages GROUP BY source
), counts AS (
  SELECT source, line, count(*) AS n_pages
  FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages)
  WHERE trim(line) <> '' GROUP BY source, line
), bad AS (
  SELECT c.source, list(c.line) AS bad
  FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n_pages >= 5 AND c.n_pages / t.total > 0.1 GROUP BY c.source
), kept AS (
  SELECT p.doc_id, p.lines, p.text,
         list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.bad, x), false)) AS rest
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(rest, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(rest), 0) AS BIGINT) AS n_dropped
FROM kept
"""
