"""Structured Streaming over the log (T8): stored windows kept current as rows arrive, in any order and however late.

Questions that are sums over rows (see ``plans.matrix``) keep their state as tables of sums beside the store. Each micro-batch is summed alone, by question,
window and keys, with the senders of capped counts; its sums are one part, under the number of the batch, so that a batch that is replayed writes
the same part again. A window's answer is made of the parts that touch it, and only windows of the batch are made anew; the log's history is not read.

Parts are folded as logs of sorted runs are: ``FOLD`` parts of one level become one of the next, so that after n batches at most (FOLD - 1) log n parts
hold everything. Which parts those are follows from the number of the batch alone. Folding lets go of windows that lie ``keep_days`` behind the
newest one seen: they are final, and a row that comes even later has its window computed again from the log.

The sums are aggregated before they are shuffled and lie in Parquet, not in a state store: one busy window is dealt over all tasks by its keys, and a
lost executor or a new query finds them as they are. Questions that do not add up (percentiles, conversions) are always computed from the log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sitelens.operators.questions import Question
from sitelens.plans.identity import identity
from sitelens.plans.matrix import TALL, added, by_name, columns_of, finished, side_by_side, tallied, windows_of
from sitelens.plans.request import Request
from sitelens.plans.windows import SIZES, WINDOW, Scheduled, Span, compute, with_windows
from sitelens.sources.stores import SummaryStore, in_days, window_day

#: Parts of one level that become one of the next.
FOLD = 16
DAY_MS = SIZES["daily"]
_TEXTS = T.ArrayType(T.StringType())
_PART = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()), T.StructField("keys", _TEXTS), T.StructField("within", _TEXTS), T.StructField("measures", T.ArrayType(T.LongType())),
        T.StructField("name", T.StringType()), T.StructField("granularity", T.StringType()), T.StructField("window_day", T.IntegerType()),
    ]
)


def touched(batch: DataFrame, granularities: Sequence[str]) -> list[Span]:
    """The windows that rows of a batch fall into: one small row each."""
    rows = with_windows(batch, list(granularities)).select("granularity", F.unix_millis("window_start").alias("ms")).distinct().collect()
    return sorted(Span(r.ms, r.granularity) for r in rows)


def live_parts(batch: int, fold: int = FOLD) -> list[tuple[int, int]]:
    """(level, last batch) of the parts that hold all batches up to one, each batch once."""
    parts, end, level, size = [], batch + 1, 0, 1
    while end:
        while end % (size * fold):
            parts.append((level, end - 1))
            end -= size
        level, size = level + 1, size * fold
    return parts


def folded_at(batch: int, fold: int = FOLD) -> list[tuple[int, list[tuple[int, int]]]]:
    """What a batch folds, lowest level first: the new part's level, and the parts that go into it."""
    out, level, size = [], 1, fold
    while (batch + 1) % size == 0:
        below = size // fold
        out.append((level, [(level - 1, batch - k * below) for k in range(fold)]))
        level, size = level + 1, size * fold
    return out


class Parts:
    """Sums by batch, under a stream's own folder."""

    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD) -> None:
        self.spark, self.root, self.fold = spark, root, fold

    def _write(self, level: int, batch: int, sums: DataFrame) -> None:
        # One folder a part, written over when a batch is replayed: the same rows again.
        # Rebalanced by folder: small ones share a task and a file, a busy day is dealt over several.
        dealt = sums.withColumn("window_day", window_day()).hint("rebalance", "name", "granularity", "window_day")
        dealt.write.mode("overwrite").partitionBy("name", "granularity", "window_day").parquet(f"{self.root}/part={level}-{batch}")

    def read(self, parts: Sequence[tuple[int, int]], spans: Sequence[Span] | None = None) -> DataFrame:
        """The rows of parts; only their folders are listed, and only directories of wanted days are read."""
        rows = None
        for level, batch in parts:
            own = self.spark.read.schema(_PART).parquet(f"{self.root}/part={level}-{batch}")
            rows = own if rows is None else rows.unionByName(own)
        return rows if spans is None else rows.filter(in_days(spans))

    def newest(self, batch: int, seen: int | None) -> int:
        """The newest day seen up to a batch, which is told by each batch for the next."""
        before = None
        if batch:
            try:
                before = self.spark.read.schema("day long").parquet(f"{self.root}/newest={batch - 1}").first()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        day = max([d for d in (before and before["day"], seen) if d is not None], default=-(1 << 40))
        self.spark.createDataFrame([(day,)], "day long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/newest={batch}")
        return day

    def take(self, batch: int, sums: DataFrame, horizon: int, widest: int) -> None:
        """Write the part of a batch, and fold what is due; windows before the horizon go."""
        kept = F.floor(F.unix_seconds("window_start") / 86_400) >= horizon
        self._write(0, batch, sums.filter(kept))
        for level, below in folded_at(batch, self.fold):
            rows = self.read(below).filter(F.col("window_day") >= horizon)
            self._write(level, batch, added(rows, widest))


class Keeper:
    """What a stream does with each micro-batch: stored windows of all scheduled questions are brought up to date."""

    def __init__(
        self, history: Callable[[], DataFrame], scheduled: Sequence[Scheduled], store: SummaryStore, stream: str = "main", keep_days: int = 7, fold: int = FOLD, now: Column | None = None,
    ) -> None:
        self.history, self.store, self.now, self.keep_days = history, store, now, keep_days
        named = by_name(scheduled)
        self.summed = {n: own for n, own in named.items() if own[0].question.tally is not None and not own[0].request.rendered_only}
        self.others = {n: own for n, own in named.items() if n not in self.summed}
        self.scheduled, self.cadences = scheduled, sorted({s.granularity for s in scheduled})
        self.parts = Parts(store.spark, f"{store.root}/parts/stream={stream}", fold)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its windows, then for its sums
        try:
            self._update(batch, number)
        finally:
            batch.unpersist()

    def _update(self, batch: DataFrame, number: int) -> None:
        spans = touched(batch, self.cadences)
        horizon = self.parts.newest(number, max((s.start // DAY_MS for s in spans), default=None)) - self.keep_days
        chosen = [s for own in self.summed.values() for s in own]
        if chosen:
            widest = max(len(s.question.added) for s in chosen)
            self.parts.take(number, tallied(windows_of(batch, chosen), chosen), horizon, widest)
        if not spans:
            return
        moment = self.store.spark.range(1).select((F.current_timestamp() if self.now is None else self.now).alias("t")).first()["t"]
        fresh, late = [[s for s in spans if (s.start // DAY_MS >= horizon) == side] for side in (True, False)]
        if chosen and fresh:
            sums = self.parts.read(live_parts(number, self.parts.fold), fresh).filter(F.col("name").isin(*self.summed) & _within(fresh)).select(*TALL)
            answers = side_by_side(finished(added(sums, widest), chosen), chosen)
            run = self.store.write_many(answers, moment)
            told = [(n, own, [w for w in fresh if w.granularity in {s.granularity for s in own}]) for n, own in self.summed.items()]
            self.store.write_ledgers([self.store.ledger_rows(n, w, moment, run, identity(own[0].question, own[0].request), columns_of(own[0])) for n, own, w in told if w])
        for name, own in [*self.others.items(), *(self.summed.items() if late else ())]:
            s, due = own[0], late if name in self.summed else spans
            due = [w for w in due if w.granularity in {x.granularity for x in own}]
            if due:
                self.store.write(name, compute(self.history(), s.question, s.request, due), due, F.lit(moment), identity(s.question, s.request))


def _within(spans: Sequence[Span]) -> Column:
    at, keep = F.unix_millis("window_start"), F.lit(False)
    for g in sorted({s.granularity for s in spans}):
        keep |= (F.col("granularity") == g) & at.isin(*[s.start for s in spans if s.granularity == g])
    return keep


def keep_all_current(stream: DataFrame, keeper: Keeper, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps the stored windows of a keeper's questions current."""
    return stream.writeStream.foreachBatch(keeper).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_current(
    stream: DataFrame, history: Callable[[], DataFrame], question: Question, request: Request, store: SummaryStore,
    checkpoint: str, granularities: Sequence[str] = ("hourly", "daily"), name: str | None = None, now: Column | None = None, **trigger,
) -> StreamingQuery:
    """The same for one question, under its own name unless another is configured.

    ``history`` gives the log as it is on disk, the rows of the batch included.
    """
    name = name or question.name
    keeper = Keeper(history, [Scheduled(name, question, g, request) for g in granularities], store, name, now=now)
    return keep_all_current(stream, keeper, checkpoint, **trigger)


def live_counts(stream: DataFrame, size: str = "1 hour", lag: str = "15 minutes") -> DataFrame:
    """Responses by window and status as a plain windowed aggregate; windows are final once the watermark passes them."""
    timed = stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", lag)
    return timed.groupBy(F.window("event_time", size).alias("w"), "sc_status").agg(F.count(F.lit(1)).alias("responses")).select("w.start", "w.end", "sc_status", "responses")
