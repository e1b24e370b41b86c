"""Document fingerprints by consistent weighted sampling.

A document is a bag of lower-cased words weighted by their counts. For each of ``SAMPLES`` draws a
word has its own r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all functions of the word; with weight w,

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1),

the word of the smallest ln a is drawn, as (word, t). Two documents draw the same with a
probability equal to their generalised Jaccard similarity, sum of min over sum of max of the weights.
Each draw is kept as 16 bits, so the share of equal draws estimates the similarity
(chance agreement: 1 in 65,536).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import for_python

SAMPLES = 64
#: Words whose draws a task remembers before it starts afresh (768 bytes each at 64 samples).
MEMORY = 100_000
#: Words whose draws are computed at a time.
PART = 4096
#: Texts of more distinct words than this are drawn part by part, without remembering their words.
LONG = 50_000
#: Documents that a range of ids aims at.
RANGE_ROWS = 4_000
#: Ranges at most; on larger tables each holds more documents, which stream through its task.
MAX_RANGES = 4_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of bags of words; the parameters of recent words stay in memory.

    For weight 1, t is 0 and ln a = ln c - r (1 - b), a constant of the word; for other weights ln a is that less r t.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.ids: dict[bytes, int] = {}
        self._room(1024)

    def _room(self, rows: int) -> None:
        """Tables of at least so many rows; what they hold is kept."""
        old = getattr(self, "hashes", np.zeros(0, np.uint64))
        if rows <= len(old):
            return
        rows = max(rows, 2 * len(old))
        grown = np.zeros(rows, np.uint64)
        grown[: len(old)] = old
        self.hashes = grown
        for name in ("r", "b", "one"):
            table = np.zeros((rows, self.samples), np.float32)
            if len(old):
                table[: len(old)] = getattr(self, name)
            setattr(self, name, table)

    def _uniforms(self, hashes: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """Two tables of uniform numbers, from the upper and the lower half of one hash each."""
        steps = (np.arange(self.samples, dtype=np.uint64) * np.uint64(3) + np.uint64(stream + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = _mix(hashes[:, None] + steps)
        scale, half = np.float32(1 / (1 << 24)), np.float32(0.5)
        upper = (mixed >> np.uint64(40)).astype(np.float32)
        lower = (mixed.view(np.uint32)[:, ::2] >> np.uint32(8)).astype(np.float32)
        return (upper + half) * scale, (lower + half) * scale

    def _parameters(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Hash, r, b and ln a at weight 1 of each word."""
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        (u0, u1), (u2, u3), (b, _) = (self._uniforms(h, k) for k in range(3))
        r = -np.log(u0 * u1)
        return h, r, b, np.log(-np.log(u2 * u3)) - r * (1 - b)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.ids)
        self._room(first + len(words))
        self.ids.update(zip(words, range(first, first + len(words))))
        for a in range(0, len(words), PART):
            part = words[a : a + PART]
            own = slice(first + a, first + a + len(part))
            self.hashes[own], self.r[own], self.b[own], self.one[own] = self._parameters(part)

    def _least(self, tables: tuple[np.ndarray, ...], at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a of the word drawn by each sample, and the mixed hash of (word, t)."""
        hashes, r_of, b_of, one = tables
        value, level, columns = one[at], np.zeros(self.samples, np.int64), np.arange(self.samples)
        many = np.flatnonzero(weight > 1)
        if len(many):
            r = r_of[at[many]]
            t = np.floor(np.log(weight[many])[:, None] / r + b_of[at[many]])
            value[many] -= r * t
        first = value.argmin(axis=0)
        if len(many):
            place = np.minimum(np.searchsorted(many, first), len(many) - 1)
            level = np.where(many[place] == first, t[place, columns], 0).astype(np.int64)
        return value[first, columns], _mix(hashes[at[first]] ^ _mix(level.view(np.uint64) + np.uint64(1)))

    def _long(self, bag: Counter[bytes]) -> np.ndarray:
        """The draws of a bag of very many words, part by part; none is remembered."""
        words, weights = list(bag), np.fromiter(bag.values(), np.float32, len(bag))
        lowest, drawn = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        for a in range(0, len(words), PART):
            part = words[a : a + PART]
            value, mixed = self._least(self._parameters(part), np.arange(len(part)), weights[a : a + PART])
            lower = value < lowest
            lowest, drawn = np.where(lower, value, lowest), np.where(lower, mixed, drawn)
        return drawn

    def _several(self, bags: list[Counter[bytes]]) -> Iterator[np.ndarray]:
        """The draws of bags of at most ``MEMORY`` words in all."""
        if len(self.ids) > MEMORY:
            self.ids.clear()
        fresh = list({w for bag in bags for w in bag} - self.ids.keys())
        if fresh:
            self._learn(fresh)
        tables, get = (self.hashes, self.r, self.b, self.one), self.ids.__getitem__
        for bag in bags:
            at = np.fromiter(map(get, bag), np.int64, len(bag))
            yield self._least(tables, at, np.fromiter(bag.values(), np.float32, len(bag)))[1]

    def signatures(self, bags: list[Counter[bytes]]) -> np.ndarray:
        """A row of 16-bit draws per bag; an empty bag draws zeros."""
        mixed = np.zeros((len(bags), self.samples), np.uint64)
        group, words = [], 0

        def settle() -> None:
            for row, draws in zip(group, self._several([bags[i] for i in group])):
                mixed[row] = draws

        for row, bag in enumerate(bags):
            if len(bag) > LONG:
                mixed[row] = self._long(bag)
            elif bag:
                if words + len(bag) > MEMORY:
                    settle()
                    group, words = [], 0
                group.append(row)
                words += len(bag)
        settle()
        return (mixed >> np.uint64(48)).astype(np.uint16)


def bag_of(text: str) -> Counter[bytes]:
    return Counter(text.encode().lower().split())


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _passed(value: Column, cuts: list[float]) -> Column:
    """How many of the falling ``cuts`` are not below the value (all of them for null), looked up in two steps."""
    step = 64
    groups = [cuts[a : a + step] for a in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    floats = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda c: value <= c))
    whole = count(floats([g[-1] for g in groups]))
    inside = F.coalesce(F.try_element_at(F.array(*[floats(g) for g in groups]), whole + 1), F.array().cast("array<double>"))
    return F.when(value.isNull(), len(cuts)).otherwise(whole * step + count(inside))


def ranges(docs: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """id, text, place, guest: documents dealt into ranges of ids, highest ids first.

    ``place`` is the number of the range. The first document of each range is also a guest, at the end, of the range
    before (of the last range, for the first): it is what the last one there is followed by. Only the
    ends of the ranges go through the driver, two numbers each.
    """
    n = docs.count()
    parts = min(max(1, -(-n // rows_per_range)), MAX_RANGES)
    cuts = docs.filter("id IS NOT NULL").approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    # range k holds ids in (cuts[k], cuts[k - 1]]; null ids come after all others
    placed = docs.withColumn("place", _passed(F.col("id"), cuts))
    tops = {r["place"]: r["top"] for r in placed.groupBy("place").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    if not order:
        return placed.withColumn("guest", F.lit(False))
    host = {p: order[k - 1] for k, p in enumerate(order)}  # the first range's top is the guest of the last
    top_of = F.array(*[F.lit(tops.get(p)).cast("long") for p in range(order[-1] + 1)])
    host_of = F.array(*[F.lit(host.get(p)).cast("int") for p in range(order[-1] + 1)])
    goes_to = F.when(F.col("id").eqNullSafe(top_of[F.col("place")]), host_of[F.col("place")])
    own = F.struct(F.col("place").alias("place"), F.lit(False).alias("guest"))
    visit = F.struct(goes_to.alias("place"), F.lit(True).alias("guest"))
    both = F.filter(F.array(own, visit), lambda x: x["place"].isNotNull())
    return placed.select("id", "text", F.explode(both).alias("at")).select("id", "text", "at.place", "at.guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lower id; the first follows the last. Among equal ids texts
    follow in byte order; null ids come last. Null texts are empty; all empty texts are alike. A table of
    one row is its own next one, and an empty table gives no rows. Repeated rows are rows of their own. Ids are numbers, or text that reads as
    whole numbers.
    """
    for_python(docs.sparkSession, 4)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = ranges(rows, RANGE_ROWS)
    inside = dealt.repartition("place").sortWithinPartitions("place", "guest", F.col("id").desc_nulls_last(), "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        last = None  # (place, id, text, signature) of the row that still waits for the next one

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids, texts, places, guests = (c.to_pylist() for c in part.columns)
                own = sampler.signatures([bag_of(t) for t in texts])
                waiting, out = [], []
                for i in range(len(ids)):
                    if last is not None and last[0] == places[i] and last[4] is False:
                        waiting.append((*last[1:4], texts[i], own[i]))
                    last = (places[i], ids[i], texts[i], own[i], guests[i])
                changed = [edited(t, nxt) for _, t, _, nxt, _ in waiting]
                for (key, t, sig, _, next_sig), e, e_sig in zip(waiting, changed, sampler.signatures([bag_of(e) for e in changed])):
                    sha = hashlib.sha256(e.encode()).hexdigest()
                    out.append((key, len(t), sha, _hex(sig), _hex(e_sig), likeness(sig, e_sig), likeness(sig, next_sig)))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"id": "Int64"}), preserve_index=False)

    out = inside.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
