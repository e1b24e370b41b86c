"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: XXH64 (seed 42) of word shingles, one bit per majority, computed per row.
2. Candidates: the 64 bits are cut into 7 blocks. Two fingerprints at 4 or fewer differing bits
   agree on at least 3 whole blocks, so every link is found under one of the 35 choices of 3 blocks.
   Only distinct fingerprints take part, 16 bytes a key.
3. Comparison inside a bucket: bit planes are stored vertically (64 fingerprints a word), the 64
   planes are added up by carry-save counters, and blocks of lanes whose counters all exceed the
   radius are abandoned. Short buckets are compared lane against shifted lane, all buckets at once;
   in long buckets a breadth-first walk compares the newly reached fingerprints with the not
   yet reached ones, so a dense group costs about one pass and no pair is listed. What such a walk has
   not settled soon is split by further blocks of bits, so a long bucket without links is not quadratic.
   Each bucket yields one edge per linked fingerprint.
4. Components: minimum labels spread over the edges by alternating large-star and small-star
   steps on Spark tables, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import cut, for_python, text_bytes

RADIUS = 4
SEED = 42
#: Widths of the 7 blocks, from the lowest bit.
WIDTHS = [10, 9, 9, 9, 9, 9, 9]
#: Buckets up to this size are compared by shifts.
SHORT = 48
#: Longer ones are walked, and what is left of one after so many comparisons is split while it is longer than LONG.
ROUNDS = 64
LONG = 4096
_STARTS = np.cumsum([0, *WIDTHS])
_MASKS = [((1 << w) - 1) << int(s) for w, s in zip(WIDTHS, _STARTS)]


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no words."""
    words = text.lower().split()  # for bytes: A-Z only, and white space is 20 and 09 to 0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)
    bits = np.zeros(64, np.int64)
    octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
    for a in range(0, n, 4096):
        bits += np.unpackbits(octets[a : a + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """id, ``fp`` (the fingerprint as a signed long) per row. Null and empty texts have 0."""
    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints: 64 rows of ceil(n / 64) words."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(differences: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Lanes (as bits of words) where at most 4 of the planes are set.

    ``differences`` yields one plane after the other when it is sent the indices of the words that are still
    open (None: all). The carry-save counter has bits 1, 2, 4; a carry out of it, or a count
    above 4, marks the lane as exceeded.
    """
    ones, twos, fours, over = (np.zeros(shape, np.uint64) for _ in range(4))
    result = np.zeros(shape, np.uint64)
    open_at: tuple[np.ndarray, ...] | None = None
    next(differences)
    for k in range(64):
        plane = differences.send(open_at)
        carry = ones & plane
        ones = ones ^ plane
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over = over | carry
        if k % 8 == 7:
            over = over | (fours & (ones | twos))
            live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if live.sum() * 2 < live.size or k == 63:
                at = np.nonzero(live)
                open_at = at if open_at is None else tuple(x[at[0]] for x in open_at)
                ones, twos, fours, over = (x[at] for x in (ones, twos, fours, over))
                if not over.size:
                    return result
    result[open_at] = ~over
    return result


def _cross(queries: np.ndarray, target: np.ndarray) -> Iterator[np.ndarray]:
    """Difference planes of each query (rows) against all lanes of the target planes."""
    sign = (queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    sign = np.where(sign == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    at = yield np.empty(0, np.uint64)
    for k in range(64):
        at = yield (sign[:, k, None] ^ target[k]) if at is None else sign[at[0], k] ^ target[k][at[1]]


def _paired(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Difference planes of two equally long sets of planes, lane by lane."""
    at = yield np.empty(0, np.uint64)
    for k in range(64):
        at = yield (left[k] ^ right[k]) if at is None else left[k][at[0]] ^ right[k][at[0]]


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def walk(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a long bucket: pairs of fingerprints that connect what is linked in it.

    What is still unsettled after ``ROUNDS`` comparisons of 64 with all the rest is split.
    """
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    rest, rounds = fps, 0  # not yet settled

    def near(step: np.ndarray) -> np.ndarray:
        target = planes(rest)
        return within(_cross(step, target), (len(step), target.shape[1]))

    while len(rest):
        step, front = rest[:64], rest[:0]
        lanes = _lanes(near(step), len(rest))
        rounds += 1
        linked = np.flatnonzero(lanes.sum(axis=1) > 1)  # each is near itself
        if not len(linked):
            rest = rest[len(step) :]
        else:
            start, reached = step[linked[0]], lanes[linked[0]]
            new, rest = rest[reached], rest[~reached]
            while len(new) or len(front):
                out_a.append(new)
                out_b.append(np.full(len(new), start))
                front = np.concatenate([front, new])
                if not len(rest) or (rounds >= ROUNDS and len(rest) > LONG):
                    break
                step, front = front[:64], front[64:]
                reached = _lanes(np.bitwise_or.reduce(near(step), axis=0), len(rest))
                rounds += 1
                new, rest = rest[reached], rest[~reached]
        if rounds >= ROUNDS and len(rest) > LONG:
            for a, b in split(np.concatenate([front, rest])):
                out_a.append(a)
                out_b.append(b)
            break
    return np.concatenate(out_a), np.concatenate(out_b)


def split(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a long bucket by smaller ones.

    The bits that differ in it are dealt into 6 further blocks. Two fingerprints within the radius agree on two of them at
    least, so each link is found under one of the 15 choices of two.
    """
    spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [k for k in range(64) if spread >> k & 1]
    for chosen in combinations(range(RADIUS + 2), 2):
        keys = fps & np.uint64(sum(1 << k for i in chosen for k in bits[i :: RADIUS + 2]))
        order = np.argsort(keys, kind="stable")
        yield links(keys[order], fps[order])


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, one it is linked to) that connect what is linked within each bucket.

    ``keys`` is sorted; fingerprints of one key are distinct.
    """
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
    sizes = ends - starts
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for a, b in zip(starts[sizes > SHORT], ends[sizes > SHORT]):
        one, other = walk(fps[a:b])
        out_a.append(one[one != other])
        out_b.append(other[one != other])
    end_of = np.repeat(np.where(sizes > SHORT, 0, ends), sizes)
    at = np.arange(len(keys))
    for shift in range(1, SHORT):
        i = at[at + shift < end_of[at]]
        if not len(i):
            break
        at = i
        hit = _lanes(within(_paired(planes(fps[i]), planes(fps[i + shift])), (-(-len(i) // 64),)), len(i))
        out_a.append(fps[i[hit] + shift])
        out_b.append(fps[i[hit]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted by key, to linked pairs; a bucket may go on over several batches."""
    held_k, held_f = [], []

    def flush(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            a, b = (x.view(np.int64) for x in links(keys, fps.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if held_k and held_k[-1][-1] == k[-1]:
            held_k.append(k)
            held_f.append(f)
            continue
        last = int(np.searchsorted(k, k[-1]))  # where the bucket begins that may go on
        yield from flush(np.concatenate([*held_k, k[:last]]), np.concatenate([*held_f, f[:last]]))
        held_k, held_f = [k[last:]], [f[last:]]
    if held_k:
        yield from flush(np.concatenate(held_k), np.concatenate(held_f))


def _block_keys(fp: Column) -> Column:
    """The 35 keys of a fingerprint: a hash of the choice of blocks and of their bits."""

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    keys = []
    for n, chosen in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS)):
        mask = sum(_MASKS[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed(mask)))))
    return F.array(*keys)


def linked_pairs(fps: DataFrame) -> DataFrame:
    """a, b: links that connect the distinct fingerprints of ``fps`` (column ``fp``) as all links do."""
    distinct = fps.select("fp").distinct()
    keyed = distinct.select(F.explode(_block_keys(F.col("fp"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b); comparable ids.

    Alternates large-star and small-star; each round's edges are a written table.
    """
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's larger neighbours hang below its smallest neighbour (or itself).
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node's smaller neighbours, and the node, hang below the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = cut(small.filter(F.col("a") != F.col("b")).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (id, fp): fp, first (its smallest id) and component; and component, component_id (its smallest id)."""
    # Fingerprints stand for themselves; each gets the smallest id that has it.
    firsts = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    label = components(linked_pairs(firsts)).select(F.col("node").alias("fp"), F.col("component"))
    named = firsts.join(label, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    return named, named.groupBy("component").agg(F.min("first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable) for every row.

    Repeated ids give repeated rows. Texts without words have fingerprint zero and are linked like
    any other. Null ids come out with the smallest id of their component (null where there is none).
    """
    rows = cut(fingerprints(docs, id_col, text, shingle))
    named, lowest = _named(rows)
    known = named.join(lowest, "component").select("fp", "component_id")
    return rows.join(known, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id.

    All columns stay. Rows are told apart by a number, not by their ids: repeated ids with different texts are rows
    of their own components. Of the rows with the smallest id the first one stays; a null id comes last. Texts without words, null ones among
    them, have fingerprint zero and are one component with whatever lies near it. An empty table stays empty.
    """
    row = "__llm_row"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    keyed = numbered.select(order.alias("id"), F.col(text).alias("text"))
    _, lowest = _named(cut(fingerprints(keyed, "id", "text", shingle)))
    return numbered.join(lowest.select(F.col("component_id.row").alias(row)), row, "left_semi").select(*docs.columns)
