"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of word ids. Every batch of documents is a shard: its words become
ids too, words that no item has become a separator, and runs of words too short to hold any window
are left out, which loses no occurrence. Over what is left the shard builds an FM-index:

* suffix array by prefix doubling, and from it the Burrows-Wheeler transform,
* a wavelet tree of the transform, whose levels answer ranks from cumulative bit counts,
* suffix positions at every 8th place of the text.

All windows are searched backwards at once; their intervals are located by walking to sampled
positions, and the spans of each document are merged. Nothing is shuffled. The benchmark goes to the
tasks in blocks of bounded size; a benchmark of several blocks takes one pass over the
documents for each block, and the spans of the passes are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import cut, for_python, text_bytes

WINDOW = 13
#: Bytes of item texts that go to the tasks at once: their windows take about 13 times as much, as 32-bit word ids.
BLOCK_BYTES = 4 << 20
SAMPLE = 8
#: Shards close at about so many words that may be part of a window.
SHARD_WORDS = 1 << 19

#: A-Z become lower case; 0-9, a-z and all bytes from 80 stay; the rest separates words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Windows:
    """Distinct windows of a block of items."""

    vocabulary: dict[bytes, int]  # ids from 1
    by_length: dict[int, np.ndarray]  # windows of that many words, one a row
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # where the items of each of them begin, and the numbers of those items
    names: list[str]
    shortest: int

    def items_of(self, length: int, window: int) -> list[str]:
        starts, items = self.owners[length]
        return [self.names[i] for i in items[starts[window] : starts[window + 1]].tolist()]


def windows_of(items: list[tuple[str, bytes]], width: int = WINDOW) -> Windows:
    vocabulary: dict[bytes, int] = {}
    rows: dict[int, list[np.ndarray]] = {}
    of: dict[int, list[np.ndarray]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        if words:
            ids = np.fromiter([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32, len(words))
            own = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
            rows.setdefault(own.shape[1], []).append(own)
            of.setdefault(own.shape[1], []).append(np.full(len(own), number, np.int32))
    by_length, owners = {}, {}
    for n in sorted(rows):
        by_length[n], which = np.unique(np.concatenate(rows.pop(n)), axis=0, return_inverse=True)
        pairs = np.unique(which.ravel().astype(np.int64) * len(items) + np.concatenate(of.pop(n)))
        starts = np.searchsorted(pairs // len(items), np.arange(len(by_length[n]) + 1))
        owners[n] = (starts, (pairs % len(items)).astype(np.int32))
    return Windows(vocabulary, by_length, owners, [name for name, _ in items], min(by_length, default=0))


class WaveletTree:
    """Ranks over a sequence of integers below 2 ** bits, one level of bits each (highest first)."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
            self.levels.append((level, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for level, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            s, a, b = ones[start], ones[low], ones[high]
            start = np.where(one, zeros + s, start - s)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return low - start, high - start

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its occurrences before that place."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level, ones, zeros in self.levels:
            s, a = ones[start], ones[at]
            one = ones[at + 1] > a
            symbol |= one.astype(at.dtype) << level
            start = np.where(one, zeros + s, start - s)
            at = np.where(one, zeros + a, at - a)
        return symbol, at - start


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling until all ranks differ."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while n and rank[order[-1]] < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        width *= 2
    return order


class FMIndex:
    """Index of a sequence of ids from 0 (separator) to ``top``: transform, ranks and sampled suffix positions.

    Equal suffixes do not occur but for the end of the sequence, where the shorter one comes first.
    """

    def __init__(self, sequence: np.ndarray, top: int) -> None:
        n = len(sequence)
        order = suffix_array(sequence)
        transform = sequence[order - 1]  # for the suffix at 0, the last symbol: the text is read as a ring
        self.n, self.tree = n, WaveletTree(transform, max(1, int(top).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns (rows of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        at = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[at, column]
            a, b = self.tree.rank(symbol, low[at], high[at])
            low[at], high[at] = self.before[symbol] + a, self.before[symbol] + b
            at = at[low[at] < high[at]]
            if not len(at):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, rows = np.arange(len(rows)), rows.copy()
        while len(at):
            done = self.sampled[rows]
            found[at[done]] = self.positions[self.sample_rank[rows[done]]] + steps[at[done]]
            at, rows = at[~done], rows[~done]
            symbol, rank = self.tree.step(rows)
            rows = self.before[symbol] + rank
            steps[at] += 1
        return found


def occurrences(sequence: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: positions in ``sequence``, and which window occurs there."""
    if not len(sequence):
        return
    index = FMIndex(sequence, len(windows.vocabulary))
    for n, rows in windows.by_length.items():
        low, high = index.search(rows)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(rows)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield n, index.locate(np.repeat(low, count) + inside), which


def _runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Start and end of the runs of ids other than 0 with at least ``shortest`` of them."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist()))


class Shard:
    """Documents whose possible words are searched together."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.places: list[tuple[int, int, int]] = []  # place in the sequence, document, word
        self.size = 1

    def add(self, document: int, words: list[bytes]) -> None:
        get = self.windows.vocabulary.get
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        for a, b in _runs(ids, self.windows.shortest):
            self.places.append((self.size, document, a))
            self.parts += [ids[a:b], np.zeros(1, np.int64)]
            self.size += b - a + 1

    def found(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Merged spans of word places, and item ids, by document."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not self.places:
            return spans, items
        at, documents, words = (np.array(x, np.int64) for x in zip(*self.places))
        all_d, all_w, all_n = [], [], []
        for n, positions, which in occurrences(np.concatenate(self.parts), self.windows):
            run = np.searchsorted(at, positions, "right") - 1
            all_d.append(documents[run])
            all_w.append(words[run] + positions - at[run])
            all_n.append(np.full(len(run), n))
            pairs = np.unique(np.stack([documents[run], which]), axis=1)
            for d, w in pairs.T.tolist():
                items.setdefault(d, set()).update(self.windows.items_of(n, w))
        d, w, n = np.concatenate(all_d), np.concatenate(all_w), np.concatenate(all_n)
        order = np.lexsort((w, d))
        for doc, a, b in zip(d[order].tolist(), w[order].tolist(), (w + n)[order].tolist()):
            own = spans.setdefault(doc, [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        return spans, items


def _search_block(docs: DataFrame, items: list[tuple[str, bytes]], kind: str, width: int) -> DataFrame:
    """id, n_words, spans, items for every row, for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(windows_of(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value

        def close(ids: list[pa.Array], counts: list[int], shard: Shard) -> pa.RecordBatch:
            spans, names = shard.found()
            n = range(len(counts))
            columns = [
                pa.concat_arrays(ids),
                pa.array(counts, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in spans.get(i, ())] for i in n], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(names.get(i, ())) for i in n], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "spans", "items"])

        ids, counts, shard = [], [], Shard(windows)
        for b in batches:
            ids.append(b.column(0))
            for text in b.column(1):
                words = words_of(text.as_py())
                if windows.by_length:
                    shard.add(len(counts), words)
                counts.append(len(words))
            if shard.size >= SHARD_WORDS or len(counts) >= 20_000:
                yield close(ids, counts, shard)
                ids, counts, shard = [], [], Shard(windows)
        if ids:
            yield close(ids, counts, shard)

    return docs.mapInArrow(run, f"id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>")


def _blocks(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded bytes, of which the driver holds one at a time; at least one block."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), text_bytes(text).alias("text"))
    rows = rows.filter(F.col("item").isNotNull() & (F.length("text") > 0)).distinct()
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        if size + len(r["text"]) > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((r["item"], bytes(r["text"])))
        size += len(r["text"])
    yield block


def search(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", width: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, ``spans`` (merged word spans hit), ``items`` (sorted ids).

    Repeated rows are searched each, and an empty table gives none. A null or empty text has no words. An item without words has no window; null item ids are
    skipped. An empty benchmark hits nothing. Extra columns are not carried along.
    """
    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = _blocks(benchmark, item_col, text)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _search_block(rows, first, kind, width).withColumnRenamed("id", id_col)
    # Several blocks: rows get a number, by which the passes' results meet again.
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    keyed = numbered.select(F.struct("row", "id").alias("id"), "text")
    kind = keyed.schema["id"].dataType.simpleString()
    hits = None
    for block in chain([first, second], blocks):
        found = cut(_search_block(keyed, block, kind, width))
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("id").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def join(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(s)))

    return merged.select(F.col("id.id").alias(id_col), "n_words", F.aggregate("spans", empty, join).alias("spans"), "items")


def judged(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_hit, n_items, items_sha256 and the contamination rule (a 20th of the words) for search()'s rows.

    One row per row, repeated ones too: a null or empty text has no words, hits nothing and is clean; its digest is that of no items. An empty
    table gives none.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text is contaminated, whatever their ids.

    All columns stay. Rows with null or empty texts stay; repeated rows stay or go together; null and repeated ids are told apart by a row number. An empty
    table stays empty, and an empty benchmark keeps every row.
    """
    row = "__llm_row"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    bad = cut(judged(search(numbered, benchmark, row, text), row).filter("contaminated").select(row))
    return numbered.join(bad, row, "left_anti").select(*docs.columns)
