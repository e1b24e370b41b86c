"""Best-fit packing by a configuration linear program.

Pieces of at most ``CAPACITY`` tokens are counted by length. A configuration is a multiset of lengths that
fits into one sequence; the covering program "as few configurations as cover every count"
depends on the histogram alone, which has at most ``CAPACITY`` entries at any input size. It is solved by
multiplicative weights. Each round prices the lengths by their weights and covers all counts with configurations that a knapsack dynamic program
finds at these prices, each as often as the counts that are left allow. Lengths that lay in sequences with free places
gain weight, so that the next round places them with more care.

The mean of the rounds solves the program in fractions; since each round is whole by itself, the round with the fewest sequences is what
that mean is rounded to. Every sequence of the plan is thus a configuration that was priced by the weights of its round. Rounds end
as soon as one meets the lower bound that the prices give by duality, which for histograms of many lengths the first round, of equal weights, often does.

The plan is small; the pieces never meet in one task. Each piece gets its rank among those of its length
(a window within hashed buckets, plus the sizes of the at most ``MOST_BUCKETS`` buckets before), and the plan says
which sequence and offset the r-th piece of each length has.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.shared import cut, for_python

CAPACITY = 1024
END = 2
#: Words whose ids a worker remembers, over all its tasks, before it starts afresh (about 150 bytes each).
MEMORY = 500_000
#: Rounds of weights at most, and how much the weight of the length with the most free places beside it grows in one.
ROUNDS, GROWTH = 6, 0.3
#: A length of weight one costs its tokens, and longer ones up to so much more, as they are the harder ones to place. Rounds take turns
#: at these starts, each of which has weights of its own.
BENDS = [0.5, 2.0, 0.1]
#: Rows that a bucket of one length aims at, and the most buckets of a length.
BUCKET_ROWS = 200
MOST_BUCKETS = 1 << 16

Config = tuple[int, ...]

#: A text may be cut before a space that a non-space follows, whatever surrounds it: the tokenizer's own
#: splitting pattern begins a new piece there.
_CUT = re.compile(r"(?= \S)")
#: What plain texts have not: an edge or two in a row of space and line end, or any other white space (RE2 syntax).
_UNPLAIN = (
    r"(?:\A|[ \n])(?:[ \n]|\z)|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Marks that the splitting pattern parts from the letters before them.
_MARKS = ".,;:!?"


class Encoder:
    """Token ids of texts; words that occurred before are not encoded again.

    In a plain text a line end is a token of its own, and a word's ids depend only on whether a space or a line begins before it.
    Words are told apart and looked up per batch by Arrow; ids lie end to end in one array, and texts are gathered from it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        [self.line_end] = self.tokenizer.encode("\n", add_special_tokens=False).ids
        [space] = self.tokenizer.model.tokenize("\u0120")
        #: Tokens that begin with a space.
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space.value) for i in range(size)])
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a word with the space before it, or without one where a line begins: its number
        self.flat, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _several(self, words: list[str], begins: np.ndarray, between: str) -> list[list[int]]:
        """Ids of words that all start with a token marked in ``begins``, many words at once."""
        lists = [words[a : a + 400] for a in range(0, len(words), 400)]
        texts = ["".join([between + w for w in part]) for part in lists]
        out: list[list[int]] = []
        for part, e in zip(lists, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = e.ids
            cuts = [*np.flatnonzero(begins[np.array(ids, np.int64)]).tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            if len(cuts) != len(part) + 1:
                raise AssertionError("words and their tokens do not match")
        return out

    def _learn(self, words: list[str]) -> None:
        """Number new words. Words of ASCII letters alone, with a mark behind or not, are one piece to the splitting pattern."""
        tokenize, known = self.tokenizer.model.tokenize, self.known
        ids: list[list[int] | None] = [None] * len(words)
        letters: dict[str, list[int]] = {}
        other, first = [], []
        for i, w in enumerate(words):
            if w[0] != " ":
                first.append(i)
                continue
            mark = w[-1] in _MARKS
            core = w[1:-1] if mark else w[1:]
            if not (core.isascii() and core.isalpha()):
                other.append(i)
                continue
            own = letters.get(core)
            if own is None:
                n = known.get(w[:-1]) if mark else None
                own = [t.id for t in tokenize("\u0120" + core)] if n is None else self.flat[self.bounds[n] : self.bounds[n + 1]].tolist()
                letters[core] = own
            ids[i] = own + self.marks[w[-1]] if mark else own
        for i, x in zip(other, self._several([words[i] for i in other], self.spaced, "")):
            ids[i] = x
        line = np.zeros(len(self.spaced), bool)
        line[self.line_end] = True
        for i, x in zip(first, self._several([words[i] for i in first], line, "\n")):
            ids[i] = x
        known.update(zip(words, range(len(known), len(known) + len(words))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))])

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, " ", "\n "), "\n")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self._forget()
            new = words
        self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        edges = split.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        begin, end = self.bounds[number], self.bounds[number + 1]
        begin[edges[:-1]] += 1  # no line end before the first word of a text
        size = end - begin
        after = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (after - size), size) + np.arange(after[-1])]
        cuts = np.concatenate(([0], after))[edges]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _odd(self, text: str) -> np.ndarray:
        parts = _CUT.split(text)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids as little-endian unsigned 32-bit numbers, per text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        unplain = pc.match_substring_regex(texts, _UNPLAIN).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~unplain)
        if len(plain):
            for i, ids in zip(plain.tolist(), self._plain(texts.take(pa.array(plain)))):
                out[i] = ids
        for i in np.flatnonzero(unplain).tolist():
            out[i] = self._odd(texts[i].as_py())
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(a, capacity) for a in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece of every row; a null text is empty."""
    for_python(docs.sparkSession, 4)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(b.column(1))):
                n_ids = len(ids) + 1
                for k, (a, n) in enumerate(cut_points(n_ids, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    own = zlib.crc32(ids[a : a + n])
                    crc.append(zlib.crc32(tail, own) if a + n == n_ids else own)
            pa.default_memory_pool().release_unused()  # workers serve other operators too
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# -- the plan: arithmetic on the histogram ---------------------------------------


def _price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity, and the index of an item of it (-1: none)."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], item[c] = best[c - 1], -2  # a place stays free
        fits = np.searchsorted(lengths, c, "right")
        if fits:
            gain = value[:fits] + best[c - lengths[:fits]]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], item[c] = gain[k], k
    return best, item


def _dual(value: np.ndarray, lengths: np.ndarray, need: np.ndarray, capacity: int) -> float:
    """A lower bound of the sequences: by duality, prices of which no configuration holds more than one in sum."""
    return float((need * value).sum() / _price(value, lengths, capacity)[0][capacity])


def _fill(rest: dict[int, int], room: int, price: dict[int, float]) -> list[int]:
    """Bounded knapsack: what is left over that is worth most in ``room``."""
    best, steps = np.zeros(room + 1), []
    for length in sorted((x for x in rest if x <= room), reverse=True):
        many, chunk = min(rest[length], room // length), 1
        while many:
            chunk = min(chunk, many)
            size = chunk * length
            new = best[:-size] + chunk * price[length]
            better = new > best[size:]
            best[size:][better] = new[better]
            steps.append((length, chunk, better))
            many, chunk = many - chunk, chunk * 2
    free, chosen = int(best.argmax()), []
    for length, chunk, better in reversed(steps):
        size = chunk * length
        if free >= size and better[free - size]:
            chosen += [length] * chunk
            free -= size
    return chosen


def _covered(counts: dict[int, int], capacity: int, price: dict[int, float]) -> Counter[Config]:
    """One round: the best configuration at these prices that holds the longest piece left, as often as the counts allow, until none is left."""
    rest, packed = dict(counts), Counter()
    while rest:
        longest = max(rest)
        rest[longest] -= 1
        config = tuple(sorted([longest, *_fill({k: n for k, n in rest.items() if n}, capacity - longest, price)], reverse=True))
        rest[longest] += 1
        own = Counter(config)
        bins = min(rest[k] // n for k, n in own.items())
        packed[config] += bins
        for k, n in own.items():
            rest[k] -= n * bins
            if not rest[k]:
                del rest[k]
    return packed


def _free_beside(packed: Counter[Config], capacity: int) -> Counter[int]:
    """By length, the free places of the sequences it lies in, shared among their pieces."""
    free: Counter[int] = Counter()
    for config, bins in packed.items():
        for k, n in Counter(config).items():
            free[k] += (capacity - sum(config)) * bins * n / len(config)
    return free


@dataclass
class Plan:
    """Sequences by content, how many each round took (their mean solves the program in fractions), and a lower bound."""

    packed: Counter[Config]
    rounds: list[int]
    bound: int


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Configurations for a histogram of lengths: full pieces stand alone, all others as the best round has them."""
    small, full = {k: n for k, n in counts.items() if n and k < capacity}, counts.get(capacity, 0)
    alone = Counter({(capacity,): full}) if full else Counter()
    if not small:
        return Plan(alone, [full], full)
    lengths = np.array(sorted(small))
    need = np.array([small[x] for x in lengths.tolist()], float)
    weights, best, taken = [np.ones(len(lengths)) for _ in BENDS], Counter(), []
    least = _dual(lengths.astype(float), lengths, need, capacity)
    for turn in range(rounds):
        weight = weights[turn % len(BENDS)]
        value = lengths * (1 + BENDS[turn % len(BENDS)] * lengths / capacity) * weight
        packed = _covered(small, capacity, dict(zip(lengths.tolist(), value.tolist())))
        taken.append(sum(packed.values()))
        if taken[-1] < min(taken[:-1], default=taken[-1] + 1):
            best = packed
        least = max(least, _dual(value, lengths, need, capacity))
        if min(taken) <= np.ceil(least - 1e-6):
            break
        free = _free_beside(packed, capacity)
        loss = np.array([free[x] for x in lengths.tolist()]) / need
        if loss.any():
            weight *= np.exp(GROWTH * loss / loss.max())
            weight /= weight.mean()
    return Plan(best + alone, [n + full for n in taken], int(np.ceil(least - 1e-6)) + full)


def slots(packed: Counter[Config]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where runs of pieces of a length go."""
    out, used, sequence = [], Counter(), 0
    for config, bins in sorted(packed.items(), reverse=True):
        offset = 0
        for length in config:
            out.append((length, used[length], sequence, offset))
            used[length] += bins
            offset += length
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 4)


# -- the placement: Spark ----------------------------------------------------------


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (a written table of pieces()) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = spark.sparkContext.broadcast(slots(plan(histogram, capacity).packed))
    # Frequent lengths are ranked in many buckets, so that no task gets all pieces of one.
    many = [x for length, n in histogram.items() if n >= 2 * BUCKET_ROWS for x in (F.lit(length), F.lit(min(n // BUCKET_ROWS, MOST_BUCKETS)))]
    buckets = F.coalesce(F.try_element_at(F.create_map(*many), F.col("length")), F.lit(1)) if many else F.lit(1)
    rows = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), buckets))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(sizes, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            slot = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            columns = [*b.columns[:5], pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut_pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are one piece of the end token alone. Repeated rows are packed each; rows of one id
    and text are told apart by nothing and may share places in any order. An empty table gives no rows.
    ``tokenizer`` is the path of a tokenizer file that exists on every executor.
    """
    found = cut(pieces(docs, tokenizer, id_col, text, capacity, end))
    return place(found, capacity).withColumnRenamed("id", id_col)
