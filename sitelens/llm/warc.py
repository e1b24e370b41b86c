"""WARC archives of pages, written with an index of their records and read back by byte ranges of it.

Each task streams its pages into archives of its own: gzip members of one record each, so that any record can be read without
those before it. For each record it gives a row of the index: archive, offset, length, page, URL and digest. The index is a Parquet
table that Spark commits, and only archives that it names count: what a lost task left behind is never read.

Reading starts from rows of the index, all or chosen ones. They are dealt by archive and block of bytes, sorted by offset, and neighbours
become one read of a byte range, out of which the records are cut.

Pages with equal payloads are found by SHA-256 before anything is written. Of those the page with the smallest id becomes the response, and
the others revisits, which hold no payload but name the response. Payloads below ``LEAST_BYTES`` are all responses.

* A null html is an empty payload; a null URL is written as the URN of its page, and null in the index.
* Null ids come after all others; a revisit of a response without an id refers to null.
* Of repeated rows (one id, one payload) one is the response and the others revisit it.
* An empty table gives an empty index. Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import attach, cut, for_python, text_bytes

#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
#: An archive that has reached so many bytes is followed by another.
ARCHIVE_BYTES = 1 << 30
#: A read covers at most so many bytes, unless one record is longer, ...
RANGE_BYTES = 8 << 20
#: ... and reads over gaps of at most so many.
GAP_BYTES = 64 << 10
#: Bytes of records that a reading task is meant to get.
TASK_BYTES = 128 << 20

_NAMES = uuid.UUID("6f9a3c52-7d1f-5a55-9a0a-0f3d2c9b7e11")
_END = b"\r\n\r\n"
# Fixed value: the profile that the WARC 1.1 standard gives to revisits of this kind.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# -- which pages are responses -------------------------------------------------


def decided(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest, revisit, refers_to for every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(html).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha2("payload", 256))})
    # Narrow rows, counted twice: a payload of a third of all pages is summed before each shuffle.
    same = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", F.col("n").alias("times"))).alias("first")
    groups = same.groupBy("digest").agg(F.sum("n").alias("n"), first).filter("n > 1")
    groups = cut(groups.select("digest", F.lit(True).alias("shared"), F.col("first.page_id").alias("first_id"), F.col("first.times").alias("times")))
    rows = attach(rows, groups, "digest")
    candidate = F.col("shared") & F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("revisit", F.coalesce(F.col("shared") & ~candidate, F.lit(False)))
    if not groups.filter("times > 1").isEmpty():
        rows = _one_of_repeated(rows, F.coalesce(candidate & (F.col("times") > 1), F.lit(False)))
    revisit = F.col("revisit")
    payload, refers = F.when(~revisit, F.col("payload")), F.when(revisit, F.col("first_id"))
    return rows.select("page_id", "url", payload.alias("payload"), "payload_bytes", F.lower(F.hex("digest")).alias("digest"), "revisit", refers.alias("refers_to"))


def _one_of_repeated(rows: DataFrame, repeated) -> DataFrame:
    """Rows with equal ids and payloads, of which only the first as written stays a response.

    They are written with a number each, and joined on it, so that even a third of all rows is dealt over all tasks.
    """
    numbered = cut(rows.filter(repeated).withColumn("number", F.monotonically_increasing_id()))
    chosen = numbered.groupBy("digest").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("chosen"))
    told = numbered.join(chosen, "number", "left").withColumn("revisit", F.col("chosen").isNull())
    return rows.filter(~repeated).unionByName(told.select(*rows.columns))


# -- records -------------------------------------------------------------------


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("ascii") + b"\r\n"


def _member(head: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = _head([*head, ("Content-Length", str(len(block)))]) + block + _END
    return squeeze.compress(whole) + squeeze.flush()


def record_id(digest: str) -> str:
    """The id of the response that others with this payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, digest)}>"


def record(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, revisit: bool, refers_to: str | None, moment: str) -> bytes:
    named = record_id(digest) if not revisit and size >= LEAST_BYTES else f"<urn:uuid:{uuid.uuid4()}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    # Whatever could end a header line is escaped, in URLs as in ids.
    target = f"urn:page:{quote(page or '', safe='')}" if url is None else quote(url, safe=_PRINTABLE)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", named), ("WARC-Date", moment), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", _PROFILE if revisit else None), ("WARC-Refers-To", record_id(digest) if revisit else None),
        ("Page-ID", None if page is None else quote(page, safe="")), ("Refers-To-Page-ID", None if refers_to is None else quote(refers_to, safe="")),
        ("Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(head, block)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; a member that is cut off, or holds more than a record, is refused."""
    loose = zlib.decompressobj(31)
    whole = loose.decompress(member)
    head, found, rest = whole.partition(_END)
    lines = head.decode("ascii").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields.get("Content-Length", -1))]
    if not loose.eof or loose.unused_data or not found or lines[0] != "WARC/1.1" or rest != block + _END:
        raise ValueError("this is no whole WARC record")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digest")
    return fields, block


# -- archives ------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system and the path in it."""
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Shelf:
    """The archives of one task. Names are its own, so another attempt never writes to the same file."""

    def __init__(self, root: str, moment: str) -> None:
        self.root, self.moment, self.out = root, moment, None
        self.fs, self.path = filesystem(root)

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= ARCHIVE_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(self.path, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.moment), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            first = _member(info, b"format: WARC File Format 1.1\r\n")
            self.out.write(first)
            self.at = len(first)
        where = self.at
        self.out.write(member)
        self.at += len(member)
        return f"{self.root}/{self.name}", where

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


_INDEX = "archive string, offset bigint, length bigint, page_id string, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to string"
_NAMES_OF = [c.split()[0] for c in _INDEX.split(", ")]


def write(pages: DataFrame, root: str, id_col: str = "page_id", url: str = "url", html: str = "html", captured: datetime | None = None) -> DataFrame:
    """Write archives under ``root`` and their index as Parquet under ``root``/index, which comes back.

    ``root`` is a folder that driver and executors share, empty or new. ``captured`` is the moment that records bear: now, if not given.
    """
    for_python(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = decided(pages, id_col, url, html).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    moment = (captured or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _Shelf(f"{root}/archives", moment)
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            members = (record(*r, moment) for r in rows)
            placed = [(*shelf.add(m), len(m)) for m in members]
            told = [(a, o, n, page, url, digest, size, "revisit" if revisit else "response", refers) for (a, o, n), (page, url, _, size, digest, revisit, refers) in zip(placed, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), _types(_INDEX))], _NAMES_OF)
        shelf.close()  # a row of the index counts once its task has ended, hence after this

    index = rows.mapInArrow(run, _INDEX).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    index.write.parquet(f"{root}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


def _types(schema: str) -> list[pa.DataType]:
    names = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return [names[c.split()[1]] for c in schema.split(", ")]


_RECORD = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def _told(member: bytes, payloads: bool) -> tuple:
    fields, block = parsed(member)
    size, digest = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(_END)[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of record {fields['WARC-Record-ID']} differs from its digest")
    page, refers = (None if fields.get(k) is None else unquote(fields[k]) for k in ("Page-ID", "Refers-To-Page-ID"))
    return page, size, digest, fields["WARC-Type"], refers, payload if payloads else None


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of rows of an index: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Size and digest are those of the full payload: counted from the archive for a response, as its headers tell for a revisit, which has no
    payload of its own. What does not match its digests is an error. With ``payloads`` false that column is null.
    """
    spark = index.sparkSession
    for_python(spark)
    kind = index.schema["page_id"].dataType.simpleString()
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    wanted = index.select("archive", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("block"))
    wanted = wanted.repartition(int(tasks), "archive", "block").sortWithinPartitions("archive", "offset").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for member in _members(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            rows.append(_told(member, payloads))
            held += len(member) + (len(rows[-1][-1] or b""))
            if held >= RANGE_BYTES or len(rows) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _types(_RECORD))], [c.split()[0] for c in _RECORD.split(", ")])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _types(_RECORD))], [c.split()[0] for c in _RECORD.split(", ")])

    return wanted.mapInArrow(run, _RECORD).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def ranges(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as runs of neighbours, each to be read at once."""
    archive, run = None, []
    for name, offset, length in places:
        near = run and name == archive and offset - sum(run[-1]) <= GAP_BYTES and offset + length - run[0][0] <= RANGE_BYTES
        if run and not near:
            yield archive, run
            run = []
        archive = name
        run.append((offset, length))
    if run:
        yield archive, run


def _members(places: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    name, source = None, None
    try:
        for archive, run in ranges(places):
            if archive != name:
                if source is not None:
                    source.close()
                fs, path = filesystem(archive)
                name, source = archive, fs.open_input_file(path)
            begin = run[0][0]
            whole = source.read_at(sum(run[-1]) - begin, begin)
            for offset, length in run:
                yield whole[offset - begin : offset - begin + length]
    finally:
        if source is not None:
            source.close()


ORACLE_SQL = f"""WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first
  FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_BYTES} AND nth > 1 THEN first END AS refers_to FROM p"""
