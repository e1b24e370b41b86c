"""Browser events that travel in the query string of beacon requests.

Two encodings live side by side: version 2 packs several events into one parameter, version 1 has one event
in separate parameters. Both become the same packed text, which is split once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import half_decoded_parameter, parameter, raw_parameter

FIELDS = ["event", "page", "value", "subject", "message"]
# Names of the beacon's own events.
VITALS = ["lcp", "cls", "fcp", "ttfb"]
ERRORS = ["error", "rejection"]


def packed_events(query: Column) -> Column:
    """Events joined by ';', their fields by ','; never null."""
    version = raw_parameter(query, "v")
    first = F.concat_ws(",", *[half_decoded_parameter(query, p) for p in ("e", "p", "n", "s", "m")])
    return F.when(version == "2", F.coalesce(parameter(query, "b"), F.lit(""))).otherwise(first)


def with_events(rows: DataFrame) -> DataFrame:
    """One row per event of each row (at least one), with the event's fields as columns."""
    query = F.col("cs_uri_query")
    each = rows.withColumn("packed", F.explode(F.split(packed_events(query), ";")))
    fields = {f: F.coalesce(F.try_url_decode(F.split_part("packed", F.lit(","), F.lit(i + 1))), F.lit("")) for i, f in enumerate(FIELDS)}
    return each.withColumn("version", raw_parameter(query, "v")).withColumns(fields).drop("packed")


def is_event() -> Column:
    """Rows of with_events() that carry an event."""
    return (F.col("cs_method") == "GET") & (F.col("cs_uri_query") != "-") & (F.col("version") != "") & (F.col("event") != "")
