"""Stored windows and reports (S6 to S8) and result files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.plans.identity import NARROWINGS, digest_of
from sitelens.plans.windows import SIZES, WINDOW, Span, as_rows


#: Version of the stored layout; rows of other versions are not read.
SCHEMA = 2
DAY = 86_400
#: Days that one pattern of paths names.
MOST_DAYS = 500
_PLACE = ["granularity", "window_day"]

#: The ledger always has these columns, whatever a run narrowed by.
LEDGER = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()), T.StructField("computed_at", T.TimestampType()),
        T.StructField("written_at", T.TimestampType()), T.StructField("run", T.StringType()), T.StructField("schema", T.IntegerType()),
        T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("limit", T.IntegerType()), T.StructField("digest", T.StringType()),
        *[T.StructField(n, kind) for n, kind in NARROWINGS.items()],
    ]
)
_KEPT = [f.name for f in LEDGER if f.name not in WINDOW]


def window_day() -> Column:
    """The UTC day of a window, by which files lie in directories."""
    return F.floor(F.unix_seconds("window_start") / DAY).cast("int")


def days_of(spans: Sequence[Span]) -> dict[str, list[int]]:
    """The directories of windows: days by granularity."""
    return {g: sorted({s.start // (DAY * 1000) for s in spans if s.granularity == g}) for g in sorted({s.granularity for s in spans})}


def in_days(spans: Sequence[Span]) -> Column:
    """Literals on the partition columns, so that other directories are not listed."""
    keep = F.lit(False)
    for g, days in days_of(spans).items():
        near = F.col("window_day").between(days[0], days[-1]) if days[-1] - days[0] + 1 == len(days) else F.col("window_day").isin(*days)
        keep |= (F.col("granularity") == g) & near
    return keep


class SummaryStore:
    """Answers by configured name and window, with a ledger of what was computed when and how it was narrowed.

    Nothing stored is ever overwritten. A run appends its rows under a number of its own, and then one ledger row per
    window; a window's rows are those of the run in its newest ledger row of one narrowing. A run that is lost before its ledger leaves rows that
    nobody reads, and the old answers standing. The ledger also tells an empty window from one that was never computed. Answers of one name that
    were narrowed otherwise stand beside each other and never for each other.

    Rows and ledger lie under name, granularity and day. Readers that name their windows list and read the directories of those days only.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- writing

    def _append(self, rows: DataFrame, path: str, *by: str) -> None:
        # Windows are dealt over tasks and lie in directories of days, so that a run leaves few files: small shuffles are coalesced.
        stamped = rows.withColumn("window_day", window_day()).repartition(*by, *WINDOW)
        stamped.write.mode("append").partitionBy(*by, *_PLACE).parquet(path)

    def write_rows(self, name: str, answer: DataFrame, moment: datetime) -> str:
        """Append the rows of a run and give its number; they do not count before the ledger names it."""
        return self.write_many(answer.withColumn("name", F.lit(name)), moment)

    def write_many(self, answers: DataFrame, moment: datetime) -> str:
        """The same for answers of several names (column ``name``) with their columns side by side, in one job."""
        run = uuid.uuid4().hex
        self._append(answers.withColumn("computed_at", F.lit(moment)).withColumn("run", F.lit(run)), f"{self.root}/rows", "name")
        return run

    def ledger_rows(self, name: str, spans: Sequence[Span], moment: datetime, run: str, asked: Mapping[str, Any], columns: Sequence[str] | None) -> DataFrame:
        sizes = F.when(F.col("granularity") == "daily", SIZES["daily"]).otherwise(SIZES["hourly"])
        told = {n: asked.get(n) for n in NARROWINGS}
        told = {**told, "limit": asked.get("limit"), "digest": digest_of(told), "columns": None if columns is None else list(columns), "computed_at": moment, "run": run, "schema": SCHEMA}
        rows = as_rows(self.spark, spans).withColumn("window_end", F.timestamp_millis(F.unix_millis("window_start") + sizes))
        typed = {f.name: F.lit(told[f.name]).cast(f.dataType) for f in LEDGER if f.name in told}
        return rows.withColumns(typed).withColumns({"written_at": F.current_timestamp(), "name": F.lit(name)})

    def write_ledger(self, name: str, spans: Sequence[Span], moment: datetime, run: str, asked: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None) -> None:
        self._append(self.ledger_rows(name, spans, moment, run, asked or {}, columns), f"{self.root}/ledger", "name")

    def write_ledgers(self, ledgers: Sequence[DataFrame]) -> None:
        """Ledger rows of several names at once."""
        self._append(reduce(lambda a, b: a.unionByName(b), ledgers), f"{self.root}/ledger", "name")

    def write(self, name: str, answer: DataFrame, spans: Sequence[Span], computed_at: Column, asked: Mapping[str, Any] | None = None, **narrowings: Any) -> None:
        """One job for all windows: the rows first, the ledger after them.

        ``asked`` is what ``identity`` gives of the request; without it, narrowings may be given by name, and those that are not are null.
        """
        moment = answer.sparkSession.range(1).select(computed_at.alias("t")).first()["t"]
        columns = [c for c in answer.columns if c not in WINDOW]
        self.write_ledger(name, spans, moment, self.write_rows(name, answer, moment), {**(asked or {}), **narrowings}, columns)

    # -- reading

    def _listed(self, kind: str, name: str, spans: Sequence[Span], schema: T.StructType | None = None) -> DataFrame | None:
        """Files of the days of windows, of which no other directories are listed; None where there are none."""
        found = None
        for g, days in days_of(spans).items():
            base = f"{self.root}/{kind}/name={name}"
            reader = self.spark.read.option("basePath", base)
            # Runs of one name may differ in their columns, as those that several names share do.
            reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
            for some in (days[k : k + MOST_DAYS] for k in range(0, len(days), MOST_DAYS)):
                try:
                    own = reader.parquet(f"{base}/granularity={g}/window_day={{{','.join(map(str, some))}}}")
                except AnalysisException as error:
                    if error.getCondition() != "PATH_NOT_FOUND":
                        raise
                    continue
                found = own if found is None else found.unionByName(own, allowMissingColumns=True)
        return None if found is None else found.filter(in_days(spans))

    def _ledger(self, name: str, wanted: Sequence[Span] | None) -> DataFrame:
        schema = T.StructType([*LEDGER, T.StructField("granularity", T.StringType()), T.StructField("window_day", T.IntegerType())])
        if wanted is not None:
            rows = self._listed("ledger", name, wanted, schema)
            return (self.spark.createDataFrame([], schema) if rows is None else rows).filter(F.col("schema") == SCHEMA)
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/ledger/name={name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)  # nothing was ever stored under this name
        return rows.filter(F.col("schema") == SCHEMA)

    def _current(self, name: str, wanted: Sequence[Span] | None = None) -> DataFrame:
        """The newest ledger row of each window and narrowing, of this version."""
        newest = self._ledger(name, wanted).groupBy(*WINDOW, "window_day", "digest").agg(F.max_by(F.struct(*[c for c in _KEPT if c != "digest"]), F.struct("written_at", "run")).alias("entry"))
        return newest.select(*WINDOW, "window_day", "digest", "entry.*")

    def ledger(self, name: str, wanted: Sequence[Span] | None = None) -> DataFrame:
        """Windows that were computed: when, how narrowed, with which columns; one row for each of them and each narrowing."""
        return self._current(name, wanted).drop("run", "schema", "written_at", "window_day")

    def entries(self, name: str, wanted: Sequence[Span]) -> list[dict[str, Any]]:
        """Ledger rows of wanted windows, of which there are as many at most as windows and narrowings of one name."""
        if not wanted:
            return []
        asked = {(s.granularity, s.start) for s in wanted}
        rows = self._current(name, wanted).withColumn("start", F.unix_millis("window_start")).collect()
        return [r.asDict(recursive=True) for r in rows if (r["granularity"], r["start"]) in asked]

    def of_entries(self, name: str, chosen: Sequence[Mapping[str, Any]]) -> DataFrame:
        """The rows of ledger entries, which may be of different runs."""
        if not chosen:
            raise ValueError("no stored windows to read")
        spans = [Span(r["start"], r["granularity"]) for r in chosen]
        rows = self._listed("rows", name, spans)
        if rows is None:  # all of them are empty: their run left no file of these days
            rows = self._rows(name).limit(0)
        runs = sorted({r["run"] for r in chosen})
        if len(runs) <= 1_000:  # a literal list that reaches the row groups
            rows = rows.filter(F.col("run").isin(*runs))
        frame = self.spark.createDataFrame([(r["granularity"], r["start"], r["run"]) for r in chosen], "granularity string, ms long, run string")
        keys = frame.select("granularity", F.timestamp_millis("ms").alias("window_start"), "run")
        columns = [c for r in chosen for c in r["columns"] or ()]
        found = rows.join(keys, [*WINDOW, "run"], "left_semi")
        return found.select(*dict.fromkeys([*WINDOW, *columns, "computed_at"])) if columns else found.drop("run", "window_day")

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/rows/name={name}")

    def read(self, name: str, wanted: Sequence[Span] | None = None, digest: str | None = None) -> DataFrame:
        """Rows of the windows as they were last computed: of all, or of ``wanted`` ones out of the directories of their days.

        ``digest`` picks one narrowing; without it, windows that were narrowed in several ways are refused when they are named.
        """
        if wanted is not None:
            chosen = [r for r in self.entries(name, wanted) if digest in (None, r["digest"])]
            if len({(r["granularity"], r["start"]) for r in chosen}) < len(chosen):
                raise ValueError(f"windows of {name} were narrowed in several ways; say which is meant")
            return self.of_entries(name, chosen)
        current = self._current(name)
        if digest is not None:
            current = current.filter(F.col("digest") == digest)
        # By day as well, so that days without a wanted window are left out while the job runs.
        return self._rows(name).join(current.select(*WINDOW, "window_day", "run"), [*WINDOW, "window_day", "run"], "left_semi").drop("run", "window_day")

    def compacted(self, name: str, root: str) -> SummaryStore:
        """A store under another root with the rows and ledger rows of ``name`` that still count.

        The caller turns to it once it is whole, and may drop the old one then.
        """
        other = SummaryStore(self.spark, root)
        current = self._current(name)
        rows = self._rows(name).join(current.select(*WINDOW, "window_day", "run"), [*WINDOW, "window_day", "run"], "left_semi")
        self._append(rows.drop("window_day").withColumn("name", F.lit(name)), f"{other.root}/rows", "name")
        self._append(current.drop("window_day").withColumn("name", F.lit(name)), f"{other.root}/ledger", "name")
        return other

    def states(self, name: str, wanted: DataFrame) -> DataFrame:
        """For each wanted window: rows, empty, or never computed."""
        keys = wanted.select(*WINDOW).distinct().withColumn("window_day", window_day())
        current = self._current(name).join(keys, [*WINDOW, "window_day"], "left_semi")
        rows = self._rows(name).join(current.select(*WINDOW, "window_day", "run"), [*WINDOW, "window_day", "run"], "left_semi")
        counts = rows.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n"))
        known = current.select(*WINDOW, F.lit(True).alias("known")).distinct().join(counts, WINDOW, "left")
        state = F.when(F.col("known").isNull(), "never computed").when(F.coalesce("n", F.lit(0)) > 0, "rows").otherwise("empty")
        return wanted.join(known, WINDOW, "left").select(*WINDOW, state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


class ReportStore:
    """Report documents by zone, unit, week start and first date.

    Each writing is a snapshot of its own; a pointer row that is appended after it makes it the one that is read. A run that is lost in between leaves
    the earlier report, and earlier snapshots stay readable. Documents of another version are refused.
    """

    KEY = ["zone", "unit", "week_start", "starts_on"]
    VERSION = 1

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        texts = ", ".join(f"{k} string" for k in self.KEY)
        self.pointer = f"snapshot string, version int, written_at timestamp, {texts}"

    def write_snapshot(self, document: DataFrame) -> tuple[str, DataFrame]:
        """The rows of documents under a new number, which nobody reads yet; with it the keys that are in them."""
        snapshot = uuid.uuid4().hex
        keyed = document.withColumns({k: F.col(k).cast("string") for k in self.KEY})
        keyed.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy(*self.KEY, "snapshot").parquet(f"{self.root}/documents")
        return snapshot, keyed.select(*self.KEY).distinct()

    def point(self, snapshot: str, keys: DataFrame, version: int | None = None) -> None:
        told = {"snapshot": F.lit(snapshot), "version": F.lit(self.VERSION if version is None else version), "written_at": F.current_timestamp()}
        keys.withColumns(told).write.mode("append").partitionBy(*self.KEY).parquet(f"{self.root}/pointers")

    def write(self, document: DataFrame) -> None:
        self.point(*self.write_snapshot(document))

    def snapshots(self, **key: str) -> DataFrame:
        """All that was ever pointed to, with ``current`` for what is read."""
        rows = self.spark.read.schema(self.pointer).parquet(f"{self.root}/pointers")
        for column, value in key.items():
            rows = rows.filter(F.col(column) == value)
        newest = F.max(F.struct("written_at", "snapshot")).over(Window.partitionBy(*self.KEY))  # as many rows as writings of one report
        return rows.withColumn("current", F.struct("written_at", "snapshot") == newest)

    def read(self, **key: str) -> DataFrame:
        """The current rows of the reports with these values."""
        current = self.snapshots(**key).filter("current")
        others = current.filter(F.col("version") != self.VERSION).select("version", *self.KEY).first()
        if others is not None:
            raise ValueError(f"a report of version {others['version']} is not read: {others['unit']} from {others['starts_on']}")
        rows = self.spark.read.parquet(f"{self.root}/documents").withColumns({k: F.col(k).cast("string") for k in self.KEY})
        for column, value in key.items():
            rows = rows.filter(F.col(column) == value)
        return rows.join(current.select(*self.KEY, "snapshot"), [*self.KEY, "snapshot"], "left_semi").drop("snapshot")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; missing values are written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header even when empty; quotes around separators, quotes and line breaks, quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
