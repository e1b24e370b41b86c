"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine has none (as in tests), a temporary folder is set for it; a cluster without one is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_shipped: set[str] = set()


def for_python(spark: SparkSession, megabytes: int = 8) -> None:
    """Ready a session for Python tasks of this package.

    Arrow batches are bounded by bytes, as texts may be very long, and the package goes to the executors once per application,
    so that workers find it wherever they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="spark-package-"))) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_cut: set[str] = set()


def _delete(folder: str, configuration: JavaObject) -> None:
    path = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(configuration).delete(path, True)


def cleared() -> None:
    """Delete the tables that this process has written with cut(), which goes by itself as it ends. Results that were not stored before are lost."""
    while _cut and SparkContext._gateway is not None:
        try:
            _delete(_cut.pop(), SparkContext._gateway.jvm.org.apache.hadoop.conf.Configuration())
        except Py4JError:  # the JVM has gone first: whoever made the folder clears it
            return


atexit.register(cleared)


def drop_shuffles() -> None:
    """Let Spark drop the shuffles that nothing refers to any more."""
    gc.collect()  # shuffle files go once neither side refers to their dataset
    SparkContext._gateway.jvm.System.gc()


def let_go(table: DataFrame) -> None:
    """Delete a table of cut() from which everything that reads it has been written, and let Spark drop the shuffles that nothing refers to any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        for known in [c for c in _cut if c.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
            _cut.discard(known)
            _delete(known, table.sparkSession.sparkContext._jsc.hadoopConfiguration())
    drop_shuffles()


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs no recomputation of what lies
    before, and the file sizes let Spark check what may be broadcast. They stay until the process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    _cut.add(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def text_bytes(column: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Up to so many rows of a lookup table are sent to every executor.
BROADCAST_ROWS = 10_000
#: Over so many tasks the rows of one key are dealt where the lookup table is larger.
SALTS = 16


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one narrow row per key; null keys match each other, others may have no match.

    ``table`` is a written one (see ``cut``), so that its rows can be counted before it is sent anywhere. A larger one is repeated once per salt
    and joined by key and salt: however many rows share a key, no task gets more than a share of them.
    """
    table = table.withColumnRenamed(key, "key_")
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), rows[key].eqNullSafe(F.col("key_")), "left").drop("key_")
    table = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("dealt_", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(table, salted[key].eqNullSafe(F.col("key_")) & (F.col("dealt_") == F.col("salt_")), "left").drop("key_", "salt_", "dealt_")
