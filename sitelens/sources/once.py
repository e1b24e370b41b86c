"""Files that are written once (C11): of any number of writers, one creates a file and all others find it there."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path on this machine, if it is one."""
    scheme, _, rest = path.partition(":")
    return path if not rest else "/" + rest.lstrip("/") if scheme == "file" else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, whole or not at all; false, and nothing changed, if it is there already.

    The text is written under another name first and then takes its place by a rename that fails if the place is taken, which the file systems of Hadoop do in one
    step; on a local file system, whose renames replace, by a hard link, which fails likewise.
    """
    data = text.encode()
    if (local := _local(path)) is not None:
        Path(local).parent.mkdir(parents=True, exist_ok=True)
        own = f"{local}.{uuid.uuid4().hex}"
        Path(own).write_bytes(data)
        try:
            os.link(own, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, own = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    files = final.getFileSystem(conf)
    out = files.create(own, False)
    out.write(data)
    out.close()
    try:
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        hadoop.FileContext.getFileContext(final.toUri(), conf).rename(own, final, options)
        return True
    except Py4JJavaError as error:
        files.delete(own, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()["value"]
