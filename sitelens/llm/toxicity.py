"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself (hashed into ``BUCKETS`` rows), so
unseen misspellings share the vectors of their n-grams. A text is cut into segments of ``SEGMENT`` words;
a segment is the mean of its ``SEGMENT`` places (zero where a text ends early) and goes through a softmax of two classes, and the text
takes the highest segment, so that one insult is not averaged away in a long text. Embeddings,
softmax and the choice of segments are trained together on a bounded sample of labelled rows.

The model is linear below the softmax, so scoring needs one number per bucket; a worker
remembers the numbers of the words it has met.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.shared import bucket_of, for_python, text_bytes

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
SEGMENT = 12
#: The bound of the training sample, per class: rows and bytes of text.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 4 << 20
#: Longer texts are not drawn for training; they are scored as whole as any.
SAMPLE_TEXT = 8 << 10
STEPS = 120
RATE = 0.2
#: How fast the scale of the steps follows gradients that get smaller.
FADE = 0.98
DECAY = 0.01
#: The weight of all toxic rows together, of 1; below a half it favours clean documents.
TOXIC_WEIGHT = 0.45
#: Words whose number a worker remembers before it starts afresh.
MEMORY = 1_000_000


@dataclass
class Model:
    weight: np.ndarray  # one number per bucket: embedding times the difference of the softmax rows
    bias: float


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself between marks, and the n-grams of that; none if it has no letters."""
    core = "".join(c for c in word.decode(errors="replace").lower() if c.isalnum())
    if not core:
        return []
    marked = f"<{core}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _segments(n: np.ndarray) -> np.ndarray:
    """Where segments begin in the texts' words, one text after the other; none for an empty text."""
    starts, base = [], 0
    for size in n.tolist():
        starts.append(np.arange(base, base + size, SEGMENT))
        base += size
    return np.concatenate(starts) if starts else np.zeros(0, np.int64)


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """Full-batch training with momentum. Texts without words teach nothing."""
    split = [words_of(t) for t in texts]
    keep = [i for i, w in enumerate(split) if w]
    y = np.array([labels[i] for i in keep], float)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else 6.0 * (2 * y[0] - 1))
    ids: dict[bytes, int] = {}
    tokens = np.array([ids.setdefault(w, len(ids)) for i in keep for w in split[i]])
    buckets, sizes_of = array("i"), array("i")
    for w in ids:
        own = features(w)
        buckets.extend(own or [0])
        sizes_of.append(len(own))
    flat, own_size = np.frombuffer(buckets, np.int32), np.frombuffer(sizes_of, np.int32)
    count = np.maximum(own_size, 1)
    share = np.repeat(np.where(own_size > 0, 1 / count, 0), count)
    begins = np.cumsum(count) - count
    sizes = np.array([len(split[i]) for i in keep])
    seg = _segments(sizes)
    seg_size = np.diff(np.append(seg, len(tokens)))  # the last one of a text may be short
    per_text = -(-sizes // SEGMENT)
    first = np.cumsum(per_text) - per_text
    weigh = np.where(y == 1, TOXIC_WEIGHT / y.sum(), (1 - TOXIC_WEIGHT) / (1 - y).sum())

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.5, DIMENSIONS), np.zeros(1)]
    moments, scale = [np.zeros_like(p) for p in params], [0.0] * 3
    owner = np.repeat(np.arange(len(keep)), per_text)
    for step in range(1, steps + 1):
        table, row, bias = params
        word = np.add.reduceat((table @ row)[flat] * share, begins)
        logit = np.add.reduceat(word[tokens], seg) / SEGMENT + bias[0]
        if step <= steps // 4:  # any segment first, then the highest
            best = first + rng.integers(0, per_text)
        else:
            order = np.lexsort((logit, owner))
            best = order[first + per_text - 1]
        slope = (1 / (1 + np.exp(-np.clip(logit[best], -50, 50))) - y) * weigh
        # Each chosen segment's words share its slope; the rest follows from linearity.
        chosen = np.zeros(len(seg))
        chosen[best] = slope / SEGMENT
        by_word = np.bincount(tokens, weights=np.repeat(chosen, seg_size), minlength=len(ids))
        by_bucket = np.bincount(flat, weights=np.repeat(by_word, count) * share, minlength=BUCKETS)
        grads = [np.outer(by_bucket, row), table.T @ by_bucket, np.array([slope.sum()])]
        # One scale for each matrix: rare buckets, which could only learn single rows by heart, move little.
        for k, (p, g) in enumerate(zip(params, grads)):
            moments[k] += 0.2 * (g - moments[k])
            scale[k] = max(FADE * scale[k], float(np.abs(moments[k]).max()))
            p -= RATE * (moments[k] / (scale[k] + 1e-12) + DECAY * p)
    table, row, bias = params
    return Model((table @ row).astype(np.float32), float(bias[0]))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Highest softmax probability of label 1 over the segments; an empty text has that of the bias."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        split = [words_of(t) for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            buckets = [features(w) for w in fresh]
            count = np.array([len(b) for b in buckets])
            flat = np.array([b for own in buckets for b in own], np.int64)
            total = np.bincount(np.repeat(np.arange(len(fresh)), count), weights=self.model.weight[flat], minlength=len(fresh))
            known.update(zip(fresh, (total / np.maximum(count, 1)).tolist()))
        n = np.array([len(w) for w in split], np.int64)
        values = np.fromiter([known[w] for words in split for w in words], float, int(n.sum()))
        logits = np.full(len(texts), self.model.bias)
        if len(values):
            seg = _segments(n)
            mean = np.add.reduceat(values, seg) / SEGMENT
            full = np.flatnonzero(n)
            per_text = -(-n[full] // SEGMENT)
            logits[full] += np.maximum.reduceat(mean, np.cumsum(per_text) - per_text)
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


#: The scorer of this worker process, by the name of its model; workers serve many tasks.
_scorers: dict[str, Scorer] = {}


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> list[tuple[bytes, int]]:
    """At most ``SAMPLE_ROWS`` labelled rows and ``SAMPLE_BYTES`` bytes of each class, by a hash of the id.

    The chosen ids are bounded, so sending them to the documents is too.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (bucket_of(id_col, 5) != 0))
    known = known.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    known = known.withColumn("order", F.xxhash64("id"))
    chosen = known.filter("y = 0").orderBy("order", "id").limit(SAMPLE_ROWS).unionByName(known.filter("y = 1").orderBy("order", "id").limit(SAMPLE_ROWS))
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.filter(F.length("text") <= SAMPLE_TEXT)
    drawn = Window.partitionBy("y").orderBy("order", "id", "text")
    # An id may be repeated: each task keeps only the first rows of a class before they meet.
    rows = rows.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= SAMPLE_ROWS)
    rows = rows.withColumn("used", F.sum(F.length("text")).over(drawn)).filter(F.col("used") <= SAMPLE_BYTES)
    return [(bytes(r.text), r.y) for r in sorted(rows.select("order", "text", "y").collect(), key=lambda r: (r.order, bytes(r.text)))]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Learns from labelled rows whose crc32(id) mod 5 is not 0; null or other labels teach nothing, a repeated id
    counts as toxic if any of its labels says so. Null texts are empty. Without labels of both classes
    the score is constant. Repeated rows have the same score each; a score of exactly one half counts as toxic. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    for_python(spark)
    drawn = sample(docs, labels, id_col, text, label)
    sent = spark.sparkContext.broadcast(train([t for t, _ in drawn], [y for _, y in drawn]))
    name = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = _scorers.get(name)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[name] = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()))], ["id", "score"])

    out = rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, (bucket_of(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
