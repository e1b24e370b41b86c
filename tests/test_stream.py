"""Stored windows kept current by a stream: replays, late rows, folded parts."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators.questions import registry
from sitelens.plans.request import HOUR, Request
from sitelens.plans.windows import Span, compute, matrix
from sitelens.derived_log import access_log, flooded
from sitelens.sources.stores import SummaryStore
from sitelens.streaming.late import Keeper, folded_at, keep_all_current, live_counts, live_parts

DAY = 24 * HOUR
ALL = Request(limit=None)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_parts_hold_each_batch_once():
    for fold in (2, 3, 16):
        written = {}
        for batch in range(300):
            written[0, batch] = {batch}
            for level, below in folded_at(batch, fold):
                written[level, batch] = set().union(*(written[p] for p in below))
            held = [b for p in live_parts(batch, fold) for b in written[p]]
            assert sorted(held) == list(range(batch + 1))
    assert len(live_parts(10**6)) <= 15 * 6


@pytest.fixture(scope="module")
def log(spark):
    part = access_log(spark, "/root/testdata/sf0.001").filter("day BETWEEN '03' AND '16'")
    return flooded(part, 70).cache()


def scheduled():
    return matrix(
        [
            ("statuses", registry()["status-codes"], ["hourly", "daily"], ALL), ("top", registry()["pageviews"], ["daily"], Request(limit=2, countries=("GB", "US"))),
            ("beacons", registry()["beacon-events"], ["daily"], ALL), ("vitals", registry()["web-vitals"], ["daily"], ALL),
        ]
    )


def test_batches_replays_and_late_rows_equal_the_batch(spark, log, tmp_path):
    """Eight batches, the fourth and the last ones twice, with rows of all days in each; days far behind are read from the log."""
    store = SummaryStore(spark, str(tmp_path))
    slot = F.when(F.col("day") < "08", F.lit(0)).when(F.col("day") < "12", F.pmod(F.hash("ts_ms", "cs_uri_stem"), F.lit(4)) + 1).otherwise(F.pmod(F.hash("ts_ms"), F.lit(3)) + 4)
    dealt = log.withColumn("slot", F.when((F.col("day") == "04") & (F.col("ts_ms") % 5 == 0), F.lit(7)).otherwise(slot)).cache()
    arrived = []
    keeper = Keeper(lambda: dealt.filter(F.col("slot").isin(*arrived)), scheduled(), store, keep_days=3, fold=2)
    for batch in range(8):
        arrived.append(batch)
        for _ in range(2 if batch in (3, 7) else 1):
            keeper(dealt.filter(F.col("slot") == batch).drop("slot"), batch)
    first = dealt.agg(F.min("ts_ms")).first()[0] // DAY * DAY
    days = [Span(first + k * DAY, "daily") for k in range(14)]
    hours = [Span(first + k * HOUR, "hourly") for k in range(14 * 24)]
    for name, question, request, spans in (
        ("statuses", registry()["status-codes"], ALL, days + hours), ("top", registry()["pageviews"], Request(limit=2, countries=("GB", "US")), days),
        ("beacons", registry()["beacon-events"], ALL, days), ("vitals", registry()["web-vitals"], ALL, days),
    ):
        want = compute(log, question, request, spans)
        assert rows(store.read(name, spans).select(*want.columns)) == rows(want), name
    # What lies behind the horizon has left the folded parts.
    top = live_parts(7, 2)
    assert top == [(3, 7)] and keeper.parts.read(top).agg(F.min("window_day")).first()[0] >= first // DAY + 13 - 3


def test_a_stream_is_resumed(spark, log, tmp_path):
    store, folder = SummaryStore(spark, str(tmp_path / "store")), str(tmp_path / "log")
    half = log.withColumn("late", F.pmod(F.hash("ts_ms"), F.lit(2)) == 0).filter("day < '06'")
    read = lambda: spark.read.schema(log.schema).parquet(folder)
    for late in (False, True):
        half.filter(F.col("late") == late).select(*log.columns).repartition(4).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(folder)
        keep_all_current(stream, Keeper(read, scheduled()[:2], store), str(tmp_path / "checkpoint")).awaitTermination()
    first = half.agg(F.min("ts_ms")).first()[0] // DAY * DAY
    spans = [Span(first + k * DAY, "daily") for k in range(3)]
    want = compute(half, registry()["status-codes"], ALL, spans)
    assert rows(store.read("statuses", spans).select(*want.columns)) == rows(want)


def test_live_counts(spark, log, tmp_path):
    folder = str(tmp_path)
    log.filter("day < '05'").coalesce(1).write.parquet(f"{folder}/log")
    stream = live_counts(spark.readStream.schema(log.schema).parquet(f"{folder}/log"))
    query = stream.writeStream.format("memory").queryName("live_counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start.timestamp() * 1000, r.sc_status): r.responses for r in spark.table("live_counts").collect()}
    want = log.filter("day < '05'").groupBy((F.col("ts_ms") - F.col("ts_ms") % HOUR).alias("h"), "sc_status").count().collect()
    assert got == {(r.h, r.sc_status): r["count"] for r in want}
