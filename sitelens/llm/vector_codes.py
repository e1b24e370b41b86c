"""Product codes of vectors, learned and assigned with exact integer arithmetic.

Components become integers floor(256 x); a vector is cut into ``PARTS`` parts, each coded by its nearest entry among ``ENTRIES``. Dot products
run in BLAS and are exact all the same: integers are broken into limbs so narrow that a sum of products of two limbs stays below 2^53,
and the products of limbs are put together in int64. Squared distances follow from them, and the first smallest wins. Where int64 would not hold
a distance (components beyond some 100,000), the batch is computed in Python's integers instead.

Codebooks are learned in rounds: each task sums the parts of each entry, 32-bit digits of those sums are added up by Spark, and the
driver divides them: at most PARTS x ENTRIES x (dimension / PARTS + 1) sums, whatever the number of vectors. Vectors are never shuffled.

* Rows whose vector is null, or holds null or a component that is no finite number, are dropped.
* The first codebook comes from the ENTRIES smallest ids; null ids come last, equal ids stand by their vectors. With fewer vectors
  the codebook has fewer entries. Each repeated row has a code of its own and counts as often as it is there.
* An empty table, or one in which no row is kept, gives an empty result.
* Vectors of different lengths, or of a length that PARTS does not divide, are an error.
* An error that a long does not hold is null, and so is the label_error it belongs to. Null labels are one label.
* Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import attach, cut, for_python

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Digits in which sums travel.
DIGIT = 32


# -- exact arithmetic ----------------------------------------------------------


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where that is wide enough, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = values * float(SCALE)  # a power of two: exact, unless it overflows
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    whole = [math.floor(s) if math.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(whole, object).reshape(values.shape)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of limbs, lowest first, as float64; all but the highest are not negative."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exact wherever the result fits into int64."""
    width = max(x.shape[1], 1)
    bits = (52 - (width - 1).bit_length()) // 2  # width products of two limbs stay below 2^53
    out = np.zeros((len(x), len(y)), np.int64)
    with np.errstate(over="ignore"):
        for i, a in enumerate(limbs(x, bits)):
            for j, b in enumerate(limbs(y, bits)):
                if bits * (i + j) < 64:
                    out += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def _fits(x: np.ndarray, y: np.ndarray, parts: int) -> bool:
    """Whether int64 holds the squared distances of all parts of a vector together."""
    most = max((max(int(v.max()), -int(v.min())) for v in (x, y) if v.size), default=0)
    return x.dtype != object and y.dtype != object and parts * max(x.shape[-1], 1) * (2 * most) ** 2 < 2**63


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (n, parts, width) and books (parts, entries, width): index of the first nearest entry, and squared distance."""
    n, parts, _ = x.shape
    if not _fits(x, books, parts):
        x, books = x.astype(object), books.astype(object)
    code, far = np.zeros((n, parts), np.int64), np.zeros((n, parts), x.dtype)
    for p in range(parts):
        own, book = x[:, p], books[p]
        product = own @ book.T if own.dtype == object else dots(own, book)
        distance = (own * own).sum(1)[:, None] - 2 * product + (book * book).sum(1)[None, :]
        code[:, p] = distance.argmin(1)
        far[:, p] = distance[np.arange(n), code[:, p]]
    return code, far


# -- tasks ---------------------------------------------------------------------


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Integers (n, PARTS, width) of a column of lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != PARTS * width).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components, where {PARTS * width} are expected")
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), PARTS, width)


def _digits(total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Digits of integers: (place, int64 values), the highest of them signed."""
    for k in range(2) if total.dtype != object else range(1 + max((abs(int(v)).bit_length() for v in total.ravel()), default=0) // DIGIT):
        last = k == 1 if total.dtype != object else not ((total >> DIGIT) + (total < 0)).any()
        yield k, (total if last else total & ((1 << DIGIT) - 1)).astype(np.int64)
        if last:
            return
        total = total >> DIGIT


def _summed(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place (-1: how many), digit, value: sums of the parts that each entry is nearest to."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _vectors(b.column(0), width)
            code, _ = nearest(x, sent.value)
            if x.dtype == object or np.abs(x).max(initial=0) > 2**31:
                x, total = x.astype(object), total.astype(object)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(x[order, p], first, axis=0)
                    count[p] += np.bincount(code[:, p], minlength=entries)
        whole = np.concatenate([count[:, :, None].astype(total.dtype), total], axis=2)
        for k, values in _digits(whole):
            p, e, place = np.nonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, place - 1, np.full(len(p), k), values[p, e, place])], ["part", "entry", "place", "digit", "value"])

    sums = kept.select("vector").mapInArrow(run, "part bigint, entry bigint, place bigint, digit bigint, value bigint")
    return sums.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value"))


def _moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The next codebooks; entries that nothing is nearest to stay."""
    total: dict[tuple[int, int, int], int] = {}
    for r in sums.collect():  # bounded by the codebooks, see above
        key = (r["part"], r["entry"], r["place"])
        total[key] = total.get(key, 0) + (int(r["value"]) << (DIGIT * r["digit"]))
    moved = books.astype(object)
    for p, e, place in np.ndindex(books.shape):
        if n := total.get((p, e, -1), 0):
            moved[p, e, place] = total.get((p, e, place), 0) // n
    return _narrow(moved)


def _narrow(whole: np.ndarray) -> np.ndarray:
    return whole.astype(np.int64) if all(abs(int(v)) < 2**62 for v in whole.ravel()) else whole


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in books.ravel())


# -- the operator --------------------------------------------------------------


def kept_rows(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & finite)


def learn(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows with ``id`` and ``vector``; None without rows."""
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not first:
        return None
    sizes = {len(r["vector"]) for r in first}
    if len(sizes) > 1 or min(sizes) % PARTS:
        raise ValueError(f"vectors of {sorted(sizes)} components cannot be cut into {PARTS} equal parts")
    start = integers(np.array([r["vector"] for r in first], np.float64))
    books = start.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(books, _summed(kept, books))
    return books


def assign(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of rows with ``id``, ``vector`` and ``label``."""
    sent = kept.sparkSession.sparkContext.broadcast(books)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, far = nearest(_vectors(b.column(2), width), sent.value)
            errors = [int(e) for e in far.sum(1)]
            hexed = [bytes(row).hex() for row in code.astype(np.uint8)]
            columns = [b.column(0), b.column(1), pa.array(hexed, pa.string()), pa.array([e if e < 2**63 else None for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return kept.select("id", "label", "vector").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: its id, code, error, label_error and codebooks_sha256."""
    for_python(vectors.sparkSession)
    kept = kept_rows(vectors, id_col, vector, label)
    books = learn(kept)
    if books is None:
        none = kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}).limit(0)
    coded = cut(assign(kept, books))
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    totals = cut(coded.groupBy("label").agg(whole.alias("label_error")))
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    rows = attach(coded, totals, "label")
    return rows.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL of the query: rounds as common table expressions, one row per part of a vector."""
    ctes = [f"""raw AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, len(embedding) // {PARTS} AS w, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"parts AS (SELECT r, p, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) for x in e[p * w + 1 : p * w + w]] AS v FROM raw CROSS JOIN (SELECT unnest(range({PARTS})) AS p))",
        f"book0 AS (SELECT p, r - 1 AS k, v AS c FROM parts WHERE r <= {ENTRIES})"]
    for i in range(ROUNDS + 1):
        # Squared distance, then the entry in one number: the smallest is the nearest, ties to the lower index.
        ctes.append(f"""code{i} AS (SELECT r, p, min(d * {ENTRIES} + k) AS dk FROM (
  SELECT r, parts.p, k, CAST(list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, len(v) + 1)]) AS BIGINT) AS d FROM parts JOIN book{i} b ON parts.p = b.p) GROUP BY r, p)""")
        if i < ROUNDS:
            ctes.append(f"""sum{i} AS (SELECT p, k, list(q ORDER BY j) AS c FROM (SELECT p, k, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM (
  SELECT parts.p, dk % {ENTRIES} AS k, unnest(v) AS x, unnest(range(len(v))) AS j FROM parts JOIN code{i} c ON parts.r = c.r AND parts.p = c.p) GROUP BY p, k, j) GROUP BY p, k)""")
            ctes.append(f"book{i + 1} AS (SELECT b.p, b.k, coalesce(s.c, b.c) AS c FROM book{i} b LEFT JOIN sum{i} s ON b.p = s.p AND b.k = s.k)")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', CAST(dk % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dk // {ENTRIES}) AS BIGINT) AS error FROM code{ROUNDS} GROUP BY r)")
    ctes.append(f"told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM raw JOIN coded ON raw.r = coded.r CROSS JOIN told"""


ORACLE_SQL = _oracle()
