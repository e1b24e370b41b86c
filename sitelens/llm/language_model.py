"""LM scoring with a hierarchical Pitman-Yor model.

Words are dishes and tokens are customers. Each training word is a context and has a restaurant for the tokens
after it; all these restaurants share the root as their parent. Each table of a context restaurant is a customer of the root; the root's base is
uniform over the known words and one place for unknown ones.

Seating follows the Chinese restaurant process and is sampled by Gibbs in blocks: a sweep empties the tables of each (context,
word) pair and seats all its customers anew, given the root without them, and then seats all customers of the root anew.
After some sweeps, ``KEPT`` seatings are kept; a token's probability is
the mean of their predictive probabilities, and scores are sums of its log10.

On Spark:

* frequent words (a share of at least ``CONTEXT_SHARE`` of the training tokens, so at most 1 / CONTEXT_SHARE of them) have numbers that every
  task knows. The tokens after all other words go once to the buckets of their contexts, by a 63-bit hash of the word: a bucket has whole restaurants, and
  the places of their customers. First tables are drawn there; words get them as customers of the root. When the root is
  seated, it sends what it has of a word to the restaurants where the word is eaten, which are then seated anew for each kept seating and score their tokens;
* tasks count (word, context) pairs of numbered contexts over blocks of text and send one message per bucket of words;
* all tables of numbered restaurants for one dish, and that dish at the root, are then in one row, so sweeps run per
  chunk of words without shuffles. Only the totals of each restaurant (bounded by the number of
  contexts) are shared; they are gathered after a first run and held fixed during the second one,
  and the final totals of each kept seating normalise its predictive probabilities;
* scoring sends, for each distinct word of a block of documents, its (document, context) places to the word's
  row and brings back sums per document, which meet the document's own row in its family of consecutive rows. Pairs above ``HEAD_SHARE`` of the training tokens (so
  at most 1 / HEAD_SHARE of them) are scored where the text is, from a broadcast table. Words above ``HOT_SHARE`` (at most
  1 / HOT_SHARE) have ``SALTS`` copies of their row, so that their places are dealt over as many tasks.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import bucket_of, cut, drop_shuffles, for_python, let_go

CONTEXT_SHARE = 1e-5
#: Blocks report the words above this part of that share of their own tokens; words that may be contexts are then counted exactly.
REPORT_PART = 0.5
HEAD_SHARE = 2e-6
HOT_SHARE = 1e-4
SALTS = 16
SWEEPS = 8
KEPT = 4
STRENGTH = 1.0
#: Bytes of text that are coded together, and documents (their places travel as 16 bits).
BLOCK_BYTES = 7 << 20
BLOCK_ROWS = 1 << 16
#: Places whose sums wait in a task, and pairs of a chunk that is sampled at once.
BLOCK_TOKENS = 1_000_000
CHUNK_PAIRS = 200_000
#: From so many training tokens, sums return in so many waves: with enough buckets, a text's tokens are summed one by one, and what returns is larger than the input.
WAVE_TOKENS = 2_000_000_000
WAVES = 4
#: Tables of sums take half the disk that Spark's usual codec leaves them.
SUMS_CODEC = "zstd"
#: Bytes of places of a bucket that are scored at once.
PART_BYTES = 16 << 20
#: Pairs with more customers draw their tables by the saddle point.
EXACT = 64
#: The end of a text, a token; no word can be equal to it. It is also the context of a text's first token.
END = "\n"
#: The number of all words without one; as a context, the root itself.
ROOT = 0
#: Keys of words without a number are above this, numbers are below.
KEYED = np.uint64(1 << 63)
#: Training tokens per bucket of keys, and the fewest buckets.
BUCKET_TOKENS = 1_000_000
LEAST_BUCKETS = 16
#: Buckets above so many travel in groups.
LEAST_GROUPS = 192
#: Bytes of messages that are taken apart at once, and of those that wait in memory for their bucket's turn.
APART_BYTES = 32 << 20
#: Bytes of messages that a task gives to Spark at once.
SENT_BYTES = 1 << 20


# -- tasks -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a C library without it
        return lambda _: 0


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the batches of each task. Python workers outlive tasks and wait beside those that run, so a task ends by giving back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows.mapInArrow(run, schema)


# -- counting ----------------------------------------------------------------------


def split_words(texts: pa.Array) -> pa.LargeListArray:
    """The words of each text, with empty ones at its edges."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))  # white space is 20 and 09 to 0D


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the last of them END; the word number of every token; and how many tokens each text has."""
    split = split_words(texts)
    flat = split.flatten().dictionary_encode()
    names, codes = flat.dictionary, flat.indices.to_numpy()
    edges = split.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    empty = pc.index(names, "").as_py()  # at the edges of texts
    if empty >= 0:
        real = codes != empty
        edges = np.concatenate(([0], np.cumsum(real)))[edges]
        codes = codes[real]
    sizes = np.diff(edges) + 1
    tokens = np.full(int(sizes.sum()), len(names), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = codes
    return pa.concat_arrays([names, pa.array([END], names.type)]), tokens, sizes


@dataclass
class Block:
    """Texts of consecutive documents."""

    texts: list[pa.Array] = field(default_factory=list)
    size: int = 0
    rows: int = 0

    def add(self, texts: pa.Array) -> None:
        self.texts.append(texts)
        self.size += texts.nbytes
        self.rows += len(texts)

    def fits(self, texts: pa.Array) -> bool:
        return not self.rows or self.size + texts.nbytes <= BLOCK_BYTES and self.rows + len(texts) <= BLOCK_ROWS

    def tokens(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return coded(pa.concat_arrays(self.texts))

    def places(self, contexts: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, and word number, context and document of every token."""
        names, words, sizes = self.tokens()
        context = numbers(names, contexts, ROOT)
        before = np.empty_like(words)
        before[1:] = context[words[:-1]]
        before[np.cumsum(sizes) - sizes] = contexts.get(END, ROOT)
        return names, words, before, np.repeat(np.arange(len(sizes)), sizes)


    def rest(self, contexts: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after words without a number, those after one word together: that word's key, the code of the token's own word, and the document."""
        names, words, sizes = self.tokens()
        codes = numbers(names, contexts, ROOT).astype(np.uint64)
        without = np.flatnonzero(codes == ROOT)
        codes[without] = word_keys(names.take(pa.array(without)))
        last = np.roll(words, 1)  # before a text's first token is the END of the text before it, or the block's last
        at = np.flatnonzero((codes >= KEYED)[last])
        at = at[np.argsort(last[at] * len(names) + words[at])]
        return codes[last[at]], codes[words[at]], np.repeat(np.arange(len(sizes)), sizes)[at]


def word_keys(names: pa.Array) -> np.ndarray:
    """63 bits of a hash of each word, and KEYED."""
    return pd.util.hash_array(names.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64) | KEYED


def numbers(names: pa.Array, of: dict[str, int], none: int) -> np.ndarray:
    at = pc.index_in(names, value_set=pa.array(list(of), names.type)).fill_null(len(of)).to_numpy(zero_copy_only=False)
    return np.fromiter([*of.values(), none], np.int64, len(of) + 1)[at]


def blocks(arrays: Iterator[pa.Array]) -> Iterator[Block]:
    block = Block()
    for texts in arrays:
        if not len(texts):
            continue
        if not block.fits(texts):
            yield block
            block = Block()
            pa.default_memory_pool().release_unused()
        block.add(texts)
    if block.rows:
        yield block


def frequent_words(texts: DataFrame) -> tuple[int, list[str]]:
    """Training tokens, and the words that become contexts: those with at least ``CONTEXT_SHARE`` of all tokens.

    Blocks report the words that reach ``REPORT_PART`` of that share among their own tokens, so that no word lacks more than that
    part of the share in its reports; where this leaves a doubt, the words concerned are counted once more, all of them.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(b.column(0) for b in batches):
            names, words, _ = block.tokens()
            counts = np.bincount(words, minlength=len(names))
            at = np.flatnonzero(counts >= max(1.0, REPORT_PART * CONTEXT_SHARE * len(words)))
            kept = pa.concat_arrays([names.take(pa.array(at)), pa.array([""], names.type)])
            yield pa.RecordBatch.from_arrays([kept.cast(pa.string()), pa.array(np.append(counts[at], len(words)))], ["word", "n"])

    counted = cut(mapped(texts, report, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    least = CONTEXT_SHARE * total
    rows = counted.filter((F.col("word") != "") & (F.col("n") >= (1 - REPORT_PART) * least)).collect()
    sure = [r.word for r in rows if r.n >= least]
    doubt = {r.word: i for i, r in enumerate(r for r in rows if r.n < least)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sums = pa.array(list(doubt), pa.large_string()), np.zeros(len(doubt), np.int64)
        for b in batches:
            found = pc.index_in(split_words(b.column(0)).flatten(), value_set=wanted).drop_null()
            sums += np.bincount(found.to_numpy(), minlength=len(doubt))
            if END in doubt:
                sums[doubt[END]] += b.num_rows
        yield pa.RecordBatch.from_arrays([wanted.cast(pa.string()), pa.array(sums)], ["word", "n"])

    if doubt:
        exact = mapped(texts, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        sure += [r.word for r in exact.collect() if r.n >= least]
    let_go(counted)
    return total, sorted(sure)


def numbered_words(texts: DataFrame) -> tuple[int, list[str]]:
    """Training tokens, and the words that get a number: all, if they are at most 1 / ``CONTEXT_SHARE``, else those of ``frequent_words``."""
    total, words = frequent_words(texts)
    most = int(1 / CONTEXT_SHARE)
    if total > 100 * most:
        return total, words

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(b.column(0) for b in batches):
            yield pa.RecordBatch.from_arrays([block.tokens()[0].cast(pa.string())], ["word"])

    every = mapped(texts, distinct, "word string").distinct().limit(most + 1).collect()
    return total, sorted(r.word for r in every) if len(every) <= most else words


# -- messages ----------------------------------------------------------------------


def _written(rows: pa.RecordBatch) -> bytes:
    """Eight bytes of its size, and a stream of one batch, compressed whole: messages are small, and Arrow would compress each buffer by itself."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    stream = sink.getvalue()
    return stream.size.to_bytes(8, "little") + pa.compress(stream, "zstd", asbytes=True)


MESSAGE = "bucket bigint, kind int, payload binary"
#: The kind that may come in parts.
LAST = 2


def bucket_count(tokens: int) -> int:
    return LEAST_BUCKETS + tokens // BUCKET_TOKENS


def group_count(buckets: int) -> int:
    """Bucket b is of group b % group_count(), as part b // group_count() of it.

    With a message from each block to each bucket, messages would grow with the square of the input, and handling one costs as much as a thousand tokens. So there is one
    to each group, and groups grow in number and in buckets alike.
    """
    return min(buckets, max(LEAST_GROUPS, 4 * math.isqrt(buckets)))


def _messages(kind: int, keys: np.ndarray, buckets: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``rows`` by the groups of their keys' buckets, a message for each. Where a group has several buckets, ``part`` tells which, ascending."""
    groups = group_count(buckets)
    parts = -(-buckets // groups)
    bucket = keys % np.uint64(buckets)
    place = (bucket % np.uint64(groups) * np.uint64(parts) + bucket // np.uint64(groups)).astype(np.uint16 if groups * parts <= 1 << 16 else np.int64)  # short integers are sorted by radix
    order = np.argsort(place, kind="stable")
    rows, place = rows.take(pa.array(order)), place[order].astype(np.int64)
    if parts > 1:
        rows = rows.append_column("part", pa.array((place % parts).astype(np.int32)))
    group = place // parts
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    sent, size = [], 0
    for a, b in zip(starts, [*starts[1:], len(group)]):
        sent.append((group[a], _written(rows.slice(a, b - a))))
        size += len(sent[-1][1])
        if size >= SENT_BYTES or b == len(group):
            to, payloads = zip(*sent)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([kind] * len(to), pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "kind", "payload"])
            sent, size = [], 0


def _read(payload: pa.Scalar) -> pa.Table:
    message = payload.as_buffer()
    size = int.from_bytes(memoryview(message)[:8], "little")
    return pa.ipc.open_stream(pa.decompress(message.slice(8), size, "zstd")).read_all()


class Apart:
    """The messages of a group, taken apart by bucket. What is more than ``APART_BYTES`` waits in a temporary file of the task."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(APART_BYTES)
        self.places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # in the file, by part and kind
        self.open: dict[tuple[int, int], list[pa.Table]] = defaultdict(list)
        self.size = 0

    def add(self, kind: int, payload: pa.Scalar) -> None:
        rows = _read(payload)
        part = rows["part"].to_numpy()
        if part[0] == part[-1]:
            self._put((int(part[0]), kind), payload.as_buffer())
            return
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(part)]):
            self.open[int(part[a]), kind].append(rows.slice(a, b - a))
        self.size += rows.nbytes
        if self.size >= APART_BYTES:
            self._close()

    def _put(self, key: tuple[int, int], message: bytes | pa.Buffer) -> None:
        self.places[key].append((self.file.tell(), len(message)))
        self.file.write(message)

    def _close(self) -> None:
        for key, tables in self.open.items():
            self._put(key, _written(pa.concat_tables(tables).combine_chunks().to_batches()[0]))
        self.open.clear()
        self.size = 0

    def each(self) -> Iterator[tuple[int, int, pa.Table]]:
        """Part, kind and rows, ordered by part and kind."""
        self._close()
        with self.file:
            for part, kind in sorted(self.places):
                for at, size in self.places[part, kind]:
                    self.file.seek(at)
                    yield part, kind, _read(pa.scalar(self.file.read(size))).drop_columns("part")


def _arrived(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, int, pa.Table]]:
    """Bucket, kind and rows of messages that are ordered by group and kind, ordered by bucket (within its group) and kind."""
    groups = group_count(buckets)
    messages = (m for b in batches for m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    if groups == buckets:
        yield from ((bucket, kind, _read(payload)) for bucket, kind, payload in messages)
        return
    now, apart = None, None
    for group, kind, payload in messages:
        if group != now and apart:
            yield from ((now + part * groups, k, rows) for part, k, rows in apart.each())
            apart = None
        now, apart = group, apart or Apart()
        apart.add(kind, payload)
    if apart:
        yield from ((now + part * groups, k, rows) for part, k, rows in apart.each())


def _meet(
    messages: DataFrame, buckets: int, work: Callable[[Iterator[tuple[int, dict[int, pa.Table]]]], Iterator[pa.RecordBatch]], schema: str, most: int | None = None
) -> DataFrame:
    """``work`` on the buckets of a task, each with its messages by kind. With ``most``, a bucket comes in parts of about so many bytes of its last kind."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, pa.Table]]]:
        now, held = None, {}
        whole = lambda: (now, {k: pa.concat_tables(v).combine_chunks() for k, v in held.items()})
        for bucket, kind, rows in _arrived(batches, buckets):
            if bucket != now and held:
                yield whole()
                held = {}
                pa.default_memory_pool().release_unused()
            now = bucket
            held.setdefault(kind, []).append(rows)
            if most and kind == LAST and sum(t.nbytes for t in held[kind]) >= most:
                yield whole()
                held = {0: held[0]} if 0 in held else {}
        if held:
            yield whole()

    return mapped(messages.repartition("bucket").sortWithinPartitions("bucket", "kind"), lambda batches: work(each(batches)), schema)


def _packed(rows: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct values of ``rows`` (sorted), and each part's slice for them as one binary value."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    edges = np.append(starts, len(rows))
    out = []
    for p in parts:
        offsets = (edges * p.itemsize).astype(np.int64)
        out.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(p.tobytes())]).cast(pa.binary()))
    return rows[starts], out


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and how many each row has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind) if len(data) else np.zeros(0, kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


def count_pairs(texts: DataFrame, contexts: list[str], buckets: int = LEAST_BUCKETS, rest: DataFrame | None = None, tables: np.ndarray | None = None) -> DataFrame:
    """word, us, cs, vs, direct: for every training word, the numbers of the contexts it follows (packed, ascending) and how often.

    ``rest`` has what first_tables() sends of contexts without a number: their tables sum to ``direct`` (of numbered words: ``tables``), and
    ``vs`` are the places of a word's pairs there, if it has no number itself. Without ``rest``, ``direct`` are the tokens that follow no numbered context.
    """
    sent = texts.sparkSession.sparkContext.broadcast(({w: i + 1 for i, w in enumerate(contexts)}, tables))
    width = len(contexts) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(b.column(0) for b in batches):
            names, words, before, _ = block.places(sent.value[0])
            keys, counts = np.unique(words * width + before, return_counts=True)
            rows, (us, cs) = _packed(keys // width, [(keys % width).astype("<u4"), counts.astype("<i8")])
            own = names.take(pa.array(rows)).cast(pa.string())
            yield from _messages(0, word_keys(own), buckets, pa.RecordBatch.from_arrays([own, us, cs], ["word", "us", "cs"]))

    def merge(each: Iterator[tuple[int, dict[int, pa.Table]]]) -> Iterator[pa.RecordBatch]:
        numbered, tables = sent.value
        for _, found in each:
            if 0 not in found:  # no training word
                continue
            coded = found[0]["word"].combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            names = coded.dictionary.take(pa.array(order))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            us, n = _unpacked(_one(found[0]["us"]), "<u4")
            cs, _ = _unpacked(_one(found[0]["cs"]), "<i8")
            keys, back = np.unique(np.repeat(place[coded.indices.to_numpy()], n) * width + us, return_inverse=True)
            sums = np.bincount(back, weights=cs).astype(np.int64)  # exact below 2 ** 53
            _, (us, cs) = _packed(keys // width, [(keys % width).astype("<u4"), sums.astype("<i8")])
            number = numbers(names, numbered, ROOT)
            at_root = keys % width == ROOT
            direct = np.bincount(keys[at_root] // width, weights=sums[at_root], minlength=len(names)) if tables is None else tables[number].astype(float)
            vs = pa.array([b""] * len(names), pa.binary())
            if 1 in found:
                w, pair, t = (found[1][k].to_numpy() for k in ("w", "pair", "t"))
                own = word_keys(names)
                by = np.argsort(own)
                to = np.minimum(np.searchsorted(own[by], w), len(by) - 1)
                known = own[by][to] == w
                word, pair, t = by[to][known], pair[known], t[known]
                direct += np.bincount(word, weights=t, minlength=len(names))
                by = np.lexsort((pair, word))
                edges = np.searchsorted(word[by], np.arange(len(names) + 1)) * 8
                vs = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(pair[by].tobytes())])
            yield pa.RecordBatch.from_arrays([names, us, cs, vs, pa.array(direct.astype(np.int64))], ["word", "us", "cs", "vs", "direct"])

    messages = mapped(texts, count, MESSAGE)
    messages = messages if rest is None else messages.unionByName(rest)
    return cut(_meet(messages, buckets, merge, "word string, us binary, cs binary, vs binary, direct bigint"))


def _once(rows: pa.Table) -> pa.Table:
    """A row per word: salts of a word may fall into one bucket."""
    first = np.unique(_one(rows["word"]).dictionary_encode().indices.to_numpy(), return_index=True)[1]
    return rows if len(first) == len(rows) else rows.take(pa.array(first)).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


# -- seating -----------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(discount: float, top: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways, weighted by sizes, to seat c customers at t tables."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(top + 1)
    for c in range(1, top):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


def seat(customers: np.ndarray, opening: np.ndarray, rest: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after all customers of each pair were seated anew, drawn from their distribution given everything else.

    t tables of c customers weigh S(c, t) opening^t (1 + 1 / rest) ... (1 + (t - 1) / rest), where ``opening`` is the weight of a first
    table and ``rest`` the weight of the dish among its parent's other customers, which every table adds one to
    (infinite: the parent does not change). Pairs of up to ``EXACT`` customers are drawn from these weights. Above, t is one more
    than a Poisson number of tables given that their sizes sum to c, and is drawn by the saddle point's mean and variance.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    size = np.minimum(customers, EXACT + 1).astype(np.uint16)  # short integers are sorted by radix
    order = np.argsort(size, kind="stable")
    ends = np.cumsum(np.bincount(size, minlength=EXACT + 2))
    table = log_stirling(discount, EXACT)
    for c in range(2, EXACT + 1):
        at = order[ends[c - 1] : ends[c]]
        if not len(at):
            continue
        # Each number of tables weighs so many times the one before it.
        k = np.arange(1, c)[:, None]
        times = (k / rest[at] + 1) * opening[at] * np.exp(np.diff(table[c, 1 : c + 1]))[:, None]
        weight = np.ones((c, len(at)))
        if c * np.log(max(times.max(), 1.0)) < 600:
            np.multiply.accumulate(times, axis=0, out=weight[1:])
        else:  # out of a double's range
            weight[1:] = np.cumsum(np.log(times), axis=0)
            weight[0] = 0
            weight = np.exp(weight - weight.max(axis=0))
        np.add.accumulate(weight, axis=0, out=weight)
        out[at] = 1 + (weight < rng.random(len(at)) * weight[-1]).sum(axis=0)
    many = order[ends[EXACT] :]
    if len(many):
        c, a0 = customers[many].astype(float), opening[many]
        t = np.ones(len(many))
        for _ in range(4):
            a = a0 * (1 + t / rest[many])
            wanted = np.log(c / a)
            # The logarithm of y, where a (1 - y) y^(d - 1) = c. Both bounds are above it; as the logarithm of the left side is concave in it, Newton's steps
            # come down to it from there.
            log_y = np.minimum(wanted / (discount - 1), -np.log1p(c / a))
            for _ in range(12):
                y = np.exp(log_y)
                log_y = log_y + (np.log1p(-y) + (discount - 1) * log_y - wanted) / (y / (1 - y) + 1 - discount)
            y = np.exp(log_y)
            mean = a * -np.expm1(discount * log_y) / discount
            t = np.minimum(1 + mean, c)
        spread = np.clip(mean - c * y / (y + (1 - y) * (1 - discount)), 1e-9, mean)
        chance = 1 - spread / mean
        tries = np.maximum(1, np.rint(mean / np.maximum(chance, 0.01)))
        drawn = np.where(chance > 0.01, rng.binomial(tries.astype(np.int64), np.minimum(mean / tries, 1)), rng.poisson(mean))
        out[many] = np.minimum(1 + drawn, customers[many])
    return out


@dataclass
class Totals:
    """What restaurants share: customers and tables by context (0: the root), per kept seating."""

    words: int
    tokens: int
    discounts: tuple[float, float]  # of the contexts, of the root
    customers: np.ndarray  # by context; row 0 unused
    tables: np.ndarray  # seating, context; column 0: tables of the root
    root_customers: np.ndarray  # by seating
    rest: bool = False  # whether words without a number are contexts too, in buckets of their own

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)


def sample_seatings(word: np.ndarray, us: np.ndarray, cs: np.ndarray, n: int, totals: Totals, seed: int, sweeps: int, kept: int, direct: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seatings of a chunk of ``n`` words, of which all pairs (word, us, cs) are given, and the root's other customers (by default, those of its pairs).

    Returns, per kept seating, tables of each pair (0 for pairs of the root), and customers and tables of each word at the root.
    """
    rng = np.random.default_rng(seed)
    d, d0 = totals.discounts
    t_mean, root_c = totals.tables.mean(axis=0), totals.root_customers.mean()
    root_opening = (STRENGTH + d0 * t_mean[0]) * totals.base
    inside = np.flatnonzero(us != ROOT)
    own, customers, opening = word[inside], cs[inside], (STRENGTH + d * t_mean[us])[inside]
    direct = np.bincount(word, weights=np.where(us == ROOT, cs, 0), minlength=n).astype(np.int64) if direct is None else direct
    # To begin with, a table for each pair.
    tables = np.minimum(customers, 1).astype(np.int64)
    root = direct + np.bincount(own, weights=tables, minlength=n).astype(np.int64)
    root_tables = np.minimum(root, 1)
    out_t, out_c, out_r = [], [], []
    for sweep in range(sweeps):
        # Half of the pairs at a time, so that pairs of one word see each other's new tables.
        half = rng.random(len(own)) < 0.5
        for part in (np.flatnonzero(half), np.flatnonzero(~half)):
            # What the root is without a pair's own tables; of the word's tables there, those go in proportion.
            w = own[part]
            others = root[w] - tables[part]
            rest = others - d0 * root_tables[w] * others / np.maximum(root[w], 1) + root_opening
            tables[part] = seat(customers[part], opening[part] * rest / (STRENGTH + root_c), rest, d, rng)
            root = direct + np.bincount(own, weights=tables, minlength=n).astype(np.int64)
        root_tables = seat(root, np.full(n, root_opening), np.full(n, np.inf), d0, rng)
        if sweep >= sweeps - kept:
            every = np.zeros(len(us), np.int64)
            every[inside] = tables
            out_t.append(every)
            out_c.append(root)
            out_r.append(root_tables)
    return np.array(out_t), np.array(out_c), np.array(out_r)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, word number, contexts and counts of chunks of the pair table."""
    rows, words, us_all, cs_all, size, n = [], [], [], [], 0, 0
    whole = lambda: (pa.Table.from_batches(rows).combine_chunks(), np.concatenate(words), np.concatenate(us_all), np.concatenate(cs_all))
    for b in batches:
        us, each = _unpacked(b.column(1), "<u4")
        cs, _ = _unpacked(b.column(2), "<i8")
        rows.append(b)
        words.append(np.repeat(np.arange(len(each)), each) + n)
        us_all.append(us.astype(np.int64))
        cs_all.append(cs)
        n, size = n + len(each), size + len(us)
        if size >= CHUNK_PAIRS:
            yield whole()
            rows, words, us_all, cs_all, size, n = [], [], [], [], 0, 0
    if n:
        yield whole()


def _sums(rows: Iterator[tuple[int, np.ndarray]], width: int) -> np.ndarray:
    out = None
    for k, values in rows:
        out = np.zeros((width, len(values))) if out is None else out
        out[k] += values
    return out if out is not None else np.zeros((width, 0))


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))


def count_totals(pairs: DataFrame, n_contexts: int, more: tuple[int, int] | None = None) -> Totals:
    """Customers by context and the discounts, from counts of counts (n1 / (n1 + 2 n2)); ``more``: pairs seen once and twice of contexts without a number."""
    width = n_contexts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        ones = np.zeros(6)  # pairs seen once and twice, words seen once and twice, words, tokens
        for names, word, us, cs in _chunks(batches):
            total += np.bincount(us, weights=cs, minlength=width)
            per_word = np.bincount(word, weights=cs, minlength=len(names))
            inside = cs[us != ROOT]
            ones += [(inside == 1).sum(), (inside == 2).sum(), (per_word == 1).sum(), (per_word == 2).sum(), len(names), cs.sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *range(-6, 0)], pa.int64()), pa.array([*total[at].tolist(), *ones.tolist()], pa.float64())], ["u", "n"])

    rows = mapped(pairs, run, "u bigint, n double").groupBy("u").agg(F.sum("n").alias("n")).collect()
    found = {r.u: r.n for r in rows}
    p1, p2, w1, w2, words, tokens = (found.get(k, 0) for k in range(-6, 0))
    customers = np.array([found.get(u, 0.0) for u in range(width)])
    tables = np.minimum(customers, customers**0.8)[None, :]
    tables[0, 0] = words
    p1, p2 = (a + b for a, b in zip((p1, p2), more or (0, 0)))
    d = (_discount(p1, p2), _discount(w1, w2))
    return Totals(int(words), int(tokens), d, customers, tables, np.array([max(tokens / 2, 1.0)]), more is not None)


def seatings(pairs: DataFrame, totals: Totals, sweeps: int, kept: int) -> DataFrame:
    """word, us, cs, ts, rc, rt, vs: the pair table with the kept seatings (packed, seating by seating)."""
    sent = pairs.sparkSession.sparkContext.broadcast(totals)
    work = lambda batches: _seated(batches, sent.value, sweeps, kept)
    return mapped(pairs, work, "word string, us binary, cs binary, ts binary, rc binary, rt binary, vs binary")


def _seated(batches: Iterator[pa.RecordBatch], totals: Totals, sweeps: int, kept: int) -> Iterator[pa.RecordBatch]:
    for rows, word, us, cs in _chunks(batches):
        names, n = _one(rows["word"]), len(rows)
        seed = zlib.crc32(names[0].as_py().encode())  # the same whenever the task is repeated
        ts, rc, rt = sample_seatings(word, us, cs, n, totals, seed, sweeps, kept, rows["direct"].to_numpy())
        _, packed = _packed(word, [us.astype("<u4"), cs.astype("<i8"), np.ascontiguousarray(ts.T).astype("<u4").reshape(-1, kept).view(f"V{4 * kept}").ravel()])
        per = [np.ascontiguousarray(x.T).astype("<i8").view(f"V{8 * kept}").ravel() for x in (rc, rt)]
        _, roots = _packed(np.arange(n), per)
        yield pa.RecordBatch.from_arrays([names, *packed, *roots, _one(rows["vs"])], ["word", "us", "cs", "ts", "rc", "rt", "vs"])


def seated_totals(seated: DataFrame, totals: Totals, kept: int, sweeps: int = 0) -> Totals:
    """The totals of the kept seatings. With ``sweeps``, of a pair table that is seated on the way, by the same worker."""
    width = len(totals.customers)
    sent = seated.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, root = np.zeros((width, kept)), np.zeros((2, kept))
        for b in _seated(batches, sent.value, sweeps, kept) if sweeps else batches:
            us, _ = _unpacked(b.column(1), "<u4")
            ts = _unpacked(b.column(3), "<u4")[0].reshape(-1, kept)
            for s in range(kept):
                tables[:, s] += np.bincount(us, weights=ts[:, s], minlength=width)
            root += [_unpacked(b.column(k), "<i8")[0].reshape(-1, kept).sum(axis=0) for k in (4, 5)]
        at = np.flatnonzero(tables.sum(axis=1))
        values = [*tables[at].tolist(), *root.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -2, -1], pa.int64()), pa.array(values, pa.list_(pa.float64()))], ["u", "n"])

    parts = [F.sum(F.col("n")[s]).alias(f"n{s}") for s in range(kept)]
    rows = mapped(seated, run, "u bigint, n array<double>").groupBy("u").agg(*parts).collect()
    found = {r.u: np.array([r[f"n{s}"] for s in range(kept)]) for r in rows}
    zero = np.zeros(kept)
    tables = np.stack([found.get(u, zero) for u in range(width)], axis=1)
    tables[:, 0] = found.get(-1, zero)
    return Totals(totals.words, totals.tokens, totals.discounts, totals.customers, tables, np.maximum(found.get(-2, zero), 0), totals.rest)


# -- contexts without a number -----------------------------------------------------


def rest_tokens(docs: DataFrame, contexts: list[str], buckets: int) -> DataFrame:
    """bucket, kind, payload, once, twice: the tokens of ``docs`` after words without a number, a row per bucket of those words.

    A payload has, ordered by u and w: u (the context's key), w (the token's word), row, and train (false: held out). ``once`` and ``twice`` are the
    pairs that occur so often in training.
    """
    sent = docs.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in enumerate(contexts)})
    groups = group_count(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first, _, held in row_blocks(batches):
            u, w, doc = block.rest(sent.value)
            train = ~pa.concat_arrays(held).to_numpy(zero_copy_only=False)
            yield from _messages(0, u, buckets, pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(first + doc), pa.array(train[doc])], ["u", "w", "row", "train"]))

    def merge(each: Iterator[tuple[int, dict[int, pa.Table]]]) -> Iterator[pa.RecordBatch]:
        for bucket, found in each:
            u, w = (found[0][k].to_numpy() for k in ("u", "w"))
            rows = found[0].take(pa.array(np.lexsort((w, u)))).combine_chunks()
            c = Rest.of(rows).c
            if buckets > groups:
                rows = rows.append_column("part", pa.array(np.full(len(rows), bucket // groups, np.int32)))
            cells = [pa.array([bucket]), pa.array([0], pa.int32()), pa.array([_written(rows.to_batches()[0])], pa.binary()), *[pa.array([int((c == k).sum())]) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "kind", "payload", "once", "twice"])

    return cut(_meet(mapped(with_row(docs), send, MESSAGE), buckets, merge, f"{MESSAGE}, once bigint, twice bigint"))


@dataclass
class Rest:
    """The pairs of a bucket of contexts without a number, ordered by context."""

    u: np.ndarray
    w: np.ndarray
    c: np.ndarray  # in training; 0 for pairs of held-out texts alone
    own: np.ndarray  # which of the contexts
    pair: np.ndarray  # by token

    @classmethod
    def of(cls, rows: pa.Table) -> Rest:
        u, w, train = (rows[k].to_numpy() for k in ("u", "w", "train"))
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        pair = np.cumsum(new) - 1
        u, w = u[new], w[new]
        return cls(u, w, np.bincount(pair, weights=train, minlength=len(u)).astype(np.int64), np.cumsum(np.concatenate(([True], u[1:] != u[:-1]))) - 1, pair)

    def totals(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, weights=of, minlength=self.own[-1] + 1)

    def sweep(self, t: np.ndarray, root: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Seat all customers anew, half of the pairs at a time, given the root's probability of each pair's word.

        A table adds ``discount`` to what opens the next one, so seat() gets exact weights.
        """
        many = np.flatnonzero(self.c > 1)
        half = rng.random(len(many)) < 0.5
        for part in (many[half], many[~half]):
            others = STRENGTH + discount * (self.totals(t)[self.own[part]] - t[part])
            t[part] = seat(self.c[part], others * root[part], others / discount, discount, rng)


def first_tables(rest: DataFrame, discount: float, buckets: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """First tables of contexts without a number: messages (w, pair, t) on words without a number, held-out pairs (0 tables) too, and tables by number.

    ``pair`` is the place of a pair: its bucket, and in the lower 32 bits its place in that bucket's Rest. A word's share of a bucket's pairs stands for the root's probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, held, waiting = np.zeros(width), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, place, t = (np.concatenate(x) for x in zip(*held))
            yield from _messages(1, w, buckets, pa.RecordBatch.from_arrays([pa.array(w), pa.array(place), pa.array(t)], ["w", "pair", "t"]))

        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
                pairs = Rest.of(_read(payload))
                rng = np.random.default_rng(bucket)
                t = np.minimum(pairs.c, 1)
                _, word, times = np.unique(pairs.w, return_inverse=True, return_counts=True)
                for _ in range(SWEEPS // 2):
                    pairs.sweep(t, times[word] / len(t), discount, rng)
                keyed = pairs.w >= KEYED
                numbered += np.bincount(pairs.w[~keyed].astype(np.int64), weights=t[~keyed], minlength=width)
                place = np.uint64(bucket << 32) | np.arange(len(t), dtype=np.uint64)
                held.append([x[keyed] for x in (pairs.w, place, t)])
                waiting += len(held[-1][0])
                if waiting >= BLOCK_TOKENS:
                    yield from flush()
                    held, waiting = [], 0
        if waiting:
            yield from flush()
        at = np.flatnonzero(numbered)
        sums = pa.RecordBatch.from_arrays([pa.array(at), pa.array(numbered[at])], ["u", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([2], pa.int32()), pa.array([_written(sums)], pa.binary())], ["bucket", "kind", "payload"])

    def by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(2):
                yield from _read(payload).to_batches()

    sent = cut(mapped(rest.select("bucket", "payload"), run, MESSAGE))
    out = np.zeros(width)
    for r in mapped(sent.filter("kind = 2"), by_number, "u bigint, n double").groupBy("u").agg(F.sum("n").alias("n")).collect():
        out[r.u] = r.n
    return sent, out


def rest_scored(rest: DataFrame, seated: DataFrame, totals: Totals, contexts: list[str], buckets: int, kept: int) -> DataFrame:
    """By family of rows: sums of the tokens after words without a number. Their contexts are seated anew for each kept seating of the root."""
    spark = rest.sparkSession
    numbered = spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(contexts)})
    width = len(contexts) + 1
    floor = np.log10(totals.tokens + totals.words + 1.0)

    d, d0 = totals.discounts
    opening, customers_of_root = (STRENGTH + d0 * totals.tables[:, 0]) * totals.base, STRENGTH + totals.root_customers

    def counted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, how often it occurs in training, and its probability at the root, seating by seating."""
        cs, each = _unpacked(b.column(1), "<i8")
        n = np.bincount(np.repeat(np.arange(len(each)), each), weights=cs, minlength=len(each)).astype(np.int64)
        rc, rt = (_unpacked(b.column(k), "<i8")[0].reshape(-1, kept) for k in (2, 3))
        return n, (rc - d0 * rt + opening) / customers_of_root

    def of_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = numbers(b.column(0), numbered.value, ROOT)
            at = np.flatnonzero(number)
            n, root = counted(b)
            yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(n[at]), pa.array(root[at].tolist(), pa.list_(pa.float64()))], ["number", "n", "root"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What contexts without a number need to know of a word without one, sent to the places of its pairs."""
        held, waiting, words = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            place, word, n, root = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(place)
            place, word = place[by], word[by]
            columns = [(place & np.uint64(0xFFFFFFFF)).astype("<u4"), n[word], *(root[word, s] for s in range(kept))]
            yield from _messages(1, place >> np.uint64(32), buckets, pa.RecordBatch.from_arrays([pa.array(x) for x in columns], reply_names))

        for b in batches:
            place, each = _unpacked(b.column(4), "<u8")
            held.append((place, np.repeat(np.arange(words, words + len(each)), each), *counted(b)))
            waiting, words = waiting + len(place), words + len(each)
            if waiting >= BLOCK_TOKENS:
                yield from flush()
                held, waiting, words = [], 0, 0
        if waiting:
            yield from flush()

    reply_names = ["at", "n", *[f"p{s}" for s in range(kept)]]
    rows = seated.select("word", "cs", "rc", "rt", "vs")
    of_number = [np.zeros(width, np.int64), np.tile(opening / customers_of_root, (width, 1))]
    for r in mapped(rows, of_numbers, "number bigint, n bigint, root array<double>").collect():
        for column, value in zip(of_number, (r.n, r.root)):
            column[r.number] = value
    sent = spark.sparkContext.broadcast(of_number)

    def score(each: Iterator[tuple[int, dict[int, pa.Table]]]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for bucket, found in each:
            pairs = Rest.of(found[0])
            code = np.where(pairs.w < KEYED, pairs.w, 0).astype(np.int64)
            n, root = (x[code] for x in sent.value)
            if 1 in found:
                at = found[1]["at"].to_numpy()
                n[at] = found[1]["n"].to_numpy()
                for s in range(kept):
                    root[at, s] = found[1][f"p{s}"].to_numpy()
            rng = np.random.default_rng(bucket)
            customers = STRENGTH + pairs.totals(pairs.c)[pairs.own]
            t, p = np.minimum(pairs.c, 1), 0
            for s in range(kept):
                for _ in range(SWEEPS - kept + 1 if s == 0 else 1):
                    pairs.sweep(t, root[:, s], d, rng)
                p += (pairs.c - d * t + (STRENGTH + d * pairs.totals(t)[pairs.own]) * root[:, s]) / customers / kept
            at = pairs.pair
            held.append(_summed(found[0]["row"].to_numpy(), (n > 0)[at], (np.log10(n + 1.0) - floor)[at], np.log10(p)[at]))
            waiting += len(held[-1][0])
            if waiting >= BLOCK_TOKENS:
                yield _family_batch(_summed(*map(np.concatenate, zip(*held))))
                held, waiting = [], 0
        if held:
            yield _family_batch(_summed(*map(np.concatenate, zip(*held))))

    replies = mapped(rows.filter(F.length("vs") > 0), reply, MESSAGE)
    by_group = rest.select((F.col("bucket") % group_count(buckets)).alias("bucket"), "kind", "payload")
    return cut(_meet(by_group.unionByName(replies), buckets, score, FAMILIES), SUMS_CODEC)


# -- scoring -----------------------------------------------------------------------


def predictive(word: np.ndarray, us: np.ndarray, cs: np.ndarray, ts: np.ndarray, rc: np.ndarray, rt: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Per pair the mean predictive probability, and per word the root's, seating by seating."""
    d, d0 = totals.discounts
    opening = STRENGTH + d0 * totals.tables[:, 0]
    root = (rc - d0 * rt + opening * totals.base) / (STRENGTH + totals.root_customers)
    lift = STRENGTH + d * totals.tables[:, us].T
    inside = (cs[:, None] - d * ts + lift * root[word]) / (STRENGTH + totals.customers[us])[:, None]
    return np.where((us == ROOT)[:, None], root[word], inside).mean(axis=1), root


def unseen(us: np.ndarray, root: np.ndarray, totals: Totals) -> np.ndarray:
    """Mean predictive probability after contexts that the word never followed; ``root`` has a row for each."""
    share = (STRENGTH + totals.discounts[0] * totals.tables[:, us].T) / (STRENGTH + totals.customers[us])[:, None]
    return (np.where((us == ROOT)[:, None], 1, share) * root).mean(axis=1)


def unknown_root(totals: Totals) -> np.ndarray:
    return (STRENGTH + totals.discounts[1] * totals.tables[:, 0]) * totals.base / (STRENGTH + totals.root_customers)


def modelled(seated: DataFrame, totals: Totals, kept: int) -> DataFrame:
    """word, n (training count), us, cs, lp (log10 of the pairs' probabilities), root (per seating)."""
    sent = seated.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, each = _unpacked(b.column(1), "<u4")
            cs, _ = _unpacked(b.column(2), "<i8")
            ts = _unpacked(b.column(3), "<u4")[0].reshape(-1, kept)
            rc, rt = (_unpacked(b.column(k), "<i8")[0].reshape(-1, kept) for k in (4, 5))
            word = np.repeat(np.arange(len(each)), each)
            p, root = predictive(word, us.astype(np.int64), cs, ts, rc, rt, sent.value)
            _, (lp,) = _packed(word, [np.log10(p).astype("<f8")])
            _, (packed_root,) = _packed(np.arange(len(each)), [root.astype("<f8").view(f"V{8 * kept}").ravel()])
            n = np.bincount(word, weights=cs, minlength=len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(1), b.column(2), lp, packed_root], ["word", "n", "us", "cs", "lp", "root"])

    return mapped(seated, run, "word string, n bigint, us binary, cs binary, lp binary, root binary")


@dataclass
class Head:
    """Frequent pairs: key = word number * width + context, ascending; values are log10 probability and count of the word."""

    words: dict[str, int]
    counts: np.ndarray
    keys: np.ndarray
    lp: np.ndarray
    hot: dict[str, int]  # words whose places are dealt over several tasks


def _hot(totals: Totals) -> float:
    return max(2.0, HOT_SHARE * totals.tokens)


def head_of(model: DataFrame, totals: Totals) -> Head:
    """The pairs with at least ``HEAD_SHARE`` of the training tokens: at most 1 / HEAD_SHARE."""
    width = len(totals.customers)
    least = max(2.0, HEAD_SHARE * totals.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, each = _unpacked(b.column(2), "<u4")
            lp, _ = _unpacked(b.column(3), "<f8")
            cs, _ = _unpacked(b.column(4), "<i8")
            word = np.repeat(np.arange(len(each)), each)
            at = cs >= least
            if at.any():
                rows, (us, lp) = _packed(word[at], [us[at], lp[at]])
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), us, lp], ["word", "n", "us", "lp"])

    rows = mapped(model.select("word", "n", "us", "lp", "cs"), run, "word string, n bigint, us binary, lp binary").collect()
    rows.sort(key=lambda r: r.word)
    hot = model.filter(F.col("n") >= _hot(totals)).select("word").collect()
    us = [np.frombuffer(r.us, "<u4").astype(np.int64) + i * width for i, r in enumerate(rows)]
    lp = [np.frombuffer(r.lp, "<f8") for r in rows]
    empty = [np.zeros(0)]
    counts = np.array([r.n for r in rows], np.int64)
    return Head({r.word: i for i, r in enumerate(rows)}, counts, np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(lp or empty), {r.word: 1 for r in hot})


#: Consecutive document rows whose sums travel together: about those of a task.
FAMILY = 8192

_SUMS = np.dtype([("member", "<u2"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def _summed(row: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums per document row, rows ascending."""
    rows, back = np.unique(row, return_inverse=True)
    return rows, *[np.bincount(back, weights=x, minlength=len(rows)) for x in (known, base, score)]


def _family_batch(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    rows, known, base, score = sums
    entries = np.zeros(len(rows), _SUMS)
    entries["member"], entries["known"], entries["base"], entries["score"] = rows % FAMILY, known, base, score
    families, (packed,) = _packed(rows // FAMILY, [entries])
    return pa.RecordBatch.from_arrays([pa.array(families), pa.nulls(len(families), pa.binary()), packed], ["family", "own", "sums"])


def _by_family(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive document rows cut where a family ends."""
    at, first = 0, rows.column(0)[0].as_py()
    while at < rows.num_rows:
        size = min(FAMILY - (first + at) % FAMILY, rows.num_rows - at)
        yield (first + at) // FAMILY, rows.slice(at, size)
        at += size


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by family: each document's own row with the sums that came back for it, which are added up as they come."""
    names = ("known", "base", "score")
    family, own, sums = None, [], np.zeros((len(names), FAMILY))

    def finished() -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables([_read(pa.scalar(piece)) for piece in own]).combine_chunks()
        member = whole["row"].to_numpy() % FAMILY
        out = [whole["id"], whole["held_out"], whole["tokens"]]
        for name, more in zip(names, sums):
            total = whole[name].to_numpy()
            out.append(pa.array(total + more[member].astype(total.dtype)))
        yield from pa.table(out, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]).to_batches()

    for b in batches:
        for now, piece, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if now != family and own:
                yield from finished()
                own = []
                sums[:] = 0
            family = now
            if piece.is_valid:
                own.append(piece.as_py())
            if packed.is_valid:
                entries = np.frombuffer(packed.as_buffer(), _SUMS)
                for to, name in zip(sums, names):
                    to[entries["member"]] += entries[name]  # a row's members differ
    if own:
        yield from finished()


FAMILIES = "family bigint, own binary, sums binary"


def with_row(docs: DataFrame) -> DataFrame:
    """Rows of a task are numbered one after the other."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, list[pa.Array], list[pa.Array]]]:
    """Blocks of with_row(), each with the number of its first row, the ids, and which rows are held out."""
    block, first, ids, held = Block(), 0, [], []
    for b in batches:
        if not b.num_rows:
            continue
        if not block.fits(b.column(3)):
            yield block, first, ids, held
            block, ids, held = Block(), [], []
            pa.default_memory_pool().release_unused()
        if not block.rows:
            first = b.column(0)[0].as_py()
        block.add(b.column(3))
        ids.append(b.column(1))
        held.append(b.column(2))
    if block.rows:
        yield block, first, ids, held


def _scored(docs: DataFrame, model: DataFrame, head: Head, totals: Totals, contexts: list[str], kept: int) -> DataFrame:
    """By family of rows of ``docs`` (id, held_out, text): the rows themselves, and the sums of their tokens, without those of rest_scored()."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((head, totals, {w: i + 1 for i, w in enumerate(contexts)}))
    width = len(contexts) + 1
    floor = np.log10(totals.tokens + totals.words + 1.0)
    buckets = bucket_count(totals.tokens)
    least = _hot(totals)
    # A token's place: its document, counted from the first of its block, and its context.
    kind_of_context = "<u2" if width <= 1 << 16 else "<u4"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: what is known here, by family of rows, and the places of other tokens, by word."""
        head, totals, numbered = sent.value

        def close(block: Block, first: int, ids: list[pa.Array], held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            names, words, before, doc = block.places(numbered)
            in_head = numbers(names, head.words, -1)
            may = np.flatnonzero((in_head >= 0)[words] & (before != ROOT)) if totals.rest else np.flatnonzero((in_head >= 0)[words])
            key = in_head[words[may]] * width + before[may]
            by = np.argsort(key)  # ascending keys are looked up faster
            key, may = key[by], may[by]
            at = np.searchsorted(head.keys, key)
            seen = head.keys[np.minimum(at, len(head.keys) - 1)] == key if len(may) else np.zeros(0, bool)
            at, may = at[seen], may[seen]
            here = np.zeros(len(words), bool)
            here[may] = True
            n = block.rows
            score = np.bincount(doc[may], weights=head.lp[at], minlength=n)
            base = np.bincount(doc[may], weights=(np.log10(head.counts + 1.0) - floor)[in_head[words[may]]], minlength=n)
            known = np.bincount(doc[may], minlength=n)
            tokens = np.bincount(doc, minlength=n)
            if totals.rest:
                here |= before == ROOT  # rest_scored() has these
            own = [pa.array(first + np.arange(n)), pa.concat_arrays(ids), pa.concat_arrays(held)]
            own += [*[pa.array(x, pa.int64()) for x in (tokens, known)], *[pa.array(x.astype(float)) for x in (base, score)]]
            own = pa.RecordBatch.from_arrays(own, ["row", "id", "held_out", "tokens", "known", "base", "score"])
            families, pieces = zip(*_by_family(own))
            own = pa.RecordBatch.from_arrays([pa.array(families), pa.array(map(_written, pieces), pa.binary())], ["family", "own"])
            yield from _messages(1, own.column(0).to_numpy().astype(np.uint64), buckets, own)
            rest = np.flatnonzero(~here)
            rest = rest[np.argsort(words[rest], kind="stable")]
            which, posts = _packed(words[rest], [doc[rest].astype("<u2"), before[rest].astype(kind_of_context)])
            named = names.take(pa.array(which)).cast(pa.string())
            salt = numbers(named, head.hot, 0) * (zlib.crc32(str(first).encode()) % SALTS)
            rows = pa.RecordBatch.from_arrays([named, pa.array(np.full(len(which), first, np.int64)), *posts], ["word", "first", "docs", "ctxs"])
            yield from _messages(LAST, word_keys(named) + salt.astype(np.uint64), buckets, rows)

        for block, first, ids, held in row_blocks(batches):
            yield from close(block, first, ids, held)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the model, by word; those of hot words to each of their salts."""
        for b in batches:
            times = np.where(b.column(1).to_numpy() >= least, SALTS, 1)
            at = np.repeat(np.arange(len(times)), times)
            salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield from _messages(0, word_keys(b.column(0))[at] + salt.astype(np.uint64), buckets, b.take(pa.array(at)))

    def remote(each: Iterator[tuple[int, dict[int, pa.Table]]]) -> Iterator[pa.RecordBatch]:
        """Sums per document row of the places of a bucket's words. The documents' own rows pass."""
        _, totals, _ = sent.value
        lost = unknown_root(totals)
        sums, waiting = [], 0
        for _, found in each:
            if 1 in found:
                own = found[1]
                yield from pa.table([own["family"], own["own"], pa.nulls(len(own), pa.binary())], ["family", "own", "sums"]).to_batches()
            if LAST not in found:
                continue
            posts, keys, lp, roots, counts = found[LAST], np.zeros(0, np.int64), np.zeros(0), lost[None], np.zeros(1, np.int64)
            which = np.zeros(len(posts), np.int64)
            if 0 in found:  # a bucket without has no word of training
                model = _once(found[0])
                at = pc.index_in(_one(posts["word"]), value_set=_one(model["word"]))
                which = at.fill_null(len(model)).to_numpy().astype(np.int64)
                us, size = _unpacked(_one(model["us"]), "<u4")
                lp, _ = _unpacked(_one(model["lp"]), "<f8")
                roots = np.concatenate([_unpacked(_one(model["root"]), "<f8")[0].reshape(-1, kept), roots])
                counts = np.append(model["n"].to_numpy(), 0)
                keys = np.repeat(np.arange(len(model)), size) * width + us
            doc, size = _unpacked(_one(posts["docs"]), "<u2")
            u = _unpacked(_one(posts["ctxs"]), kind_of_context)[0].astype(np.int64)
            g = np.repeat(which, size)
            want = g * width + u
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            seen = keys[at] == want if len(keys) else np.zeros(len(want), bool)
            score = np.empty(len(want))
            score[seen] = lp[at[seen]]
            score[~seen] = np.log10(unseen(u[~seen], roots[g[~seen]], totals))
            sums.append(_summed(np.repeat(posts["first"].to_numpy(), size) + doc, (counts > 0)[g], (np.log10(counts + 1.0) - floor)[g], score))
            waiting += len(sums[-1][0])
            if waiting >= BLOCK_TOKENS:
                yield _family_batch(_summed(*map(np.concatenate, zip(*sums))))
                sums, waiting = [], 0
        if sums:
            yield _family_batch(_summed(*map(np.concatenate, zip(*sums))))

    rows = mapped(model.select("word", "n", "us", "lp", "root"), dealt, MESSAGE)
    return _meet(rows.unionByName(mapped(with_row(docs), local, MESSAGE)), buckets, remote, FAMILIES, PART_BYTES)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows that are not held out (by default those whose crc32(id) mod 7 is not 2). Null texts are
    empty: one end token. Unknown words share one probability. With nothing to learn from, every token
    has the base probability. Repeated rows count each.

    Rows are told apart by their place in ``docs``, which has to give them in one order whenever a task is repeated, as files do.
    """
    spark = docs.sparkSession
    for_python(spark, 2)
    held_out = bucket_of(id_col, 7) == 2 if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = rows.filter(~F.col("held_out")).select("text")
    total, contexts = numbered_words(texts)
    buckets = bucket_count(total)
    rest = rest_tokens(rows, contexts, buckets)
    once, twice = (x or 0 for x in rest.agg(F.sum("once"), F.sum("twice")).first())
    first, tables = first_tables(rest, _discount(once, twice), buckets, len(contexts) + 1)
    pairs = count_pairs(texts, contexts, buckets, first.filter("kind = 1"), tables)
    let_go(first)
    guess = count_totals(pairs, len(contexts), (once, twice))
    seated = cut(seatings(pairs, seated_totals(pairs, guess, 1, SWEEPS // 2), SWEEPS, KEPT))
    let_go(pairs)
    totals = seated_totals(seated, guess, KEPT)
    others = rest_scored(rest, seated, totals, contexts, buckets, KEPT)
    let_go(rest)
    model = cut(modelled(seated, totals, KEPT))
    let_go(seated)
    sums = _scored(rows, model, head_of(model, totals), totals, contexts, KEPT)
    kind_of_id = rows.schema["id"].dataType.simpleString()

    def gathered(some: DataFrame) -> DataFrame:
        # What comes back is packed by family of consecutive rows: never more rows than families and flushes, nor more entries than places.
        packed = some.repartition("family").sortWithinPartitions("family")
        return mapped(packed, _gathered, f"id {kind_of_id}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")

    if total < WAVE_TOKENS:
        found = gathered(sums.unionByName(others))
    else:  # the places that were sent go before the sums return, and these return in waves of families
        sums = cut(sums, SUMS_CODEC)
        let_go(model)
        waves, wave = [], F.pmod(F.xxhash64("family"), F.lit(WAVES))
        for w in range(WAVES):
            waves.append(cut(gathered(sums.unionByName(others).filter(wave == w))))
            drop_shuffles()
        let_go(sums)
        let_go(others)
        found = reduce(DataFrame.unionByName, waves)
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
