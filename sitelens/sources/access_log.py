"""The access log as a table (S1 to S5): JSON lines or Parquet under date directories, all columns text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The delivered field names, in order, and the columns they become.
FIELDS = {
    "timestamp(ms)": "timestamp_ms",
    "x-host-header": "x_host_header",
    "cs-method": "cs_method",
    "cs-uri-stem": "cs_uri_stem",
    "cs-uri-query": "cs_uri_query",
    "sc-status": "sc_status",
    "sc-content-type": "sc_content_type",
    "cs(Referer)": "cs_referer",
    "cs(User-Agent)": "cs_user_agent",
    "x-edge-result-type": "x_edge_result_type",
    "c-country": "c_country",
    "c-ip": "c_ip",
}
COLUMNS = list(FIELDS.values())
PARTITIONS = ["distributionid", "year", "month", "day", "hour"]


def chosen_columns(fields: Sequence[str] | None = None, viewer_address: bool = True) -> list[str]:
    """The columns of a delivery; unknown fields are refused, the time is always there."""
    names = COLUMNS if fields is None else [FIELDS.get(f, f) for f in fields]
    if unknown := sorted(set(names) - set(COLUMNS)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return [c for c in COLUMNS if (c in names or c == "timestamp_ms") and (viewer_address or c != "c_ip")]


def _partitions(granularity: str) -> list[str]:
    if granularity not in ("hourly", "daily"):
        raise ValueError("partitions are hourly or daily")
    return PARTITIONS if granularity == "hourly" else PARTITIONS[:-1]


def _schema(names: Sequence[str], granularity: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *_partitions(granularity)]])


def typed(log: DataFrame) -> DataFrame:
    """With ``ts_ms``, null where the time is no number."""
    return log.withColumn("ts_ms", F.col("timestamp_ms").try_cast("long"))


def read_json(spark: SparkSession, root: str, columns: Sequence[str] = COLUMNS, granularity: str = "hourly") -> DataFrame:
    """JSON lines (gzip or not); partition columns come from the directories and stay text."""
    delivered = {c: f for f, c in FIELDS.items()}
    rows = spark.read.schema(_schema([delivered[c] for c in columns], granularity)).json(root)
    return typed(rows.select(*[F.col(f"`{delivered[c]}`").alias(c) for c in columns], *_partitions(granularity)))


def read_parquet(spark: SparkSession, root: str, columns: Sequence[str] = COLUMNS, granularity: str = "hourly", curated: bool = False) -> DataFrame:
    """Parquet; column names match in any case, and columns that old files lack are null.

    ``curated`` logs (see below) hold ``ts_ms`` as a typed column, so a span is pushed down to their row groups.
    """
    schema = _schema(columns, granularity)
    if curated:
        return spark.read.schema(schema.add("ts_ms", T.LongType())).parquet(root)
    return typed(spark.read.schema(schema).parquet(root))


def curate(log: DataFrame, root: str, granularity: str = "hourly") -> None:
    """Write a typed log as Parquet in the same layout, sorted by time within files so that row groups are skipped.

    Tasks hold ranges of (partition, time): a busy hour or day is dealt over several, quiet ones share one.
    """
    keys = _partitions(granularity)
    log.repartitionByRange(*keys, "ts_ms").sortWithinPartitions(*keys, "ts_ms").write.mode("overwrite").partitionBy(*keys).parquet(root)


def one_distribution(log: DataFrame, distribution: str) -> DataFrame:
    return log.filter(F.col("distributionid") == distribution)


def together(deliveries: Sequence[DataFrame]) -> DataFrame:
    """Several deliveries as one table; they must agree on their columns."""
    first, *rest = deliveries
    for other in rest:
        if other.columns != first.columns:
            raise ValueError("deliveries differ in their columns")
        first = first.unionByName(other)
    return first
