"""Language ID by prediction by partial matching (PPM).

A bounded sample of labelled rows gives, per language, byte counts in a tree of contexts of up to
``ORDER`` bytes that were seen ``LEAST`` times or more. The statistics are then frozen. A byte that a context has not seen escapes to the
context without its first byte, with probability q / (n + q) for n bytes seen, q of them distinct (method C);
bytes already ruled out are excluded from the shorter context, so every context's distribution sums to
one, and costs are exact code lengths (in 1/256 bit, added as integers).

As nothing changes while scoring, each language's tree is an automaton over its contexts: state = the longest known context,
one step a byte. Texts are cut into chunks that warm up on the ``ORDER`` bytes before them, which is all that a state
depends on, and the chunks of a batch are stepped side by side in numpy. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.shared import bucket_of, for_python

ORDER = 4
#: The bound of the training sample: bytes of text per language.
SAMPLE_BYTES = 1 << 20
#: Contexts seen less often in the sample teach too little and are left to the shorter ones.
LEAST = 16
CHUNK = 512
UNKNOWN = "und"
#: A cell of an automaton: the next state above these bits, the cost in them.
_COST_BITS = 14
_UNIT = 256


@dataclass
class Model:
    languages: list[str]
    cells: list[np.ndarray]  # per language: state * 256 + byte -> next state and cost


def _keys(data: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``k`` bytes of the same text come before a byte, and those bytes as one number (the nearest lowest)."""
    at = np.flatnonzero(inside >= k)
    key = np.zeros(len(at), np.uint32)
    for back in range(1, k + 1):
        key |= data[at - back].astype(np.uint32) << np.uint32(8 * (back - 1))
    return at, key


def tree(texts: list[bytes], order: int = ORDER, least: int = LEAST) -> np.ndarray:
    """The automaton of one language's texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    inside = np.arange(len(data), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    levels = []  # sorted contexts of each length; as counts never grow with the length, with each come its prefix and suffix
    for k in range(1, order + 1):
        values, counts = np.unique(_keys(data, inside, k)[1], return_counts=True)
        levels.append(values[counts >= least].astype(np.int64))
    first = np.cumsum([1, *map(len, levels)])  # the first state of each level; 0 is the empty context
    n = int(first[-1])
    parent, follow = np.zeros(n, np.int64), np.zeros((n, 256), np.uint32)
    for k in range(order + 1):
        own = np.arange(first[k - 1], first[k]) if k else np.zeros(1, np.int64)
        if k:
            shorter = levels[k - 1] & ((1 << 8 * (k - 1)) - 1)
            parent[own] = first[k - 2] + np.searchsorted(levels[k - 2], shorter) if k > 1 else 0
            follow[own] = follow[parent[own]]
        if k < order:
            before = levels[k] >> 8
            at = first[k - 1] + np.searchsorted(levels[k - 1], before) if k else np.zeros(len(before), np.int64)
            follow[at, levels[k] & 255] = first[k] + np.arange(len(levels[k]))
    p = np.empty((n, 256), np.float32)
    for k in range(order + 1):
        own = np.arange(first[k - 1], first[k]) if k else np.zeros(1, np.int64)
        if not len(own):
            continue
        if k:
            at, key = _keys(data, inside, k)
            where = np.minimum(np.searchsorted(levels[k - 1], key), len(own) - 1)
            known = levels[k - 1][where] == key
            cells = where[known] * 256 + data[at[known]]
        else:
            cells = data
        c = np.bincount(cells, minlength=len(own) * 256).reshape(len(own), 256)
        above = p[parent[own]] if k else np.full((1, 256), 1 / 256, np.float32)
        seen, total = c > 0, c.sum(axis=1, keepdims=True)
        distinct = seen.sum(axis=1, keepdims=True)
        unseen = np.where(seen, 0, above).sum(axis=1, keepdims=True, dtype=np.float64)
        escape = np.where(unseen > 0, distinct, 0)
        rest = escape / np.maximum(total + escape, 1) / np.maximum(unseen, 1e-300)
        p[own] = np.where(seen, c / np.maximum(total + escape, 1), above * rest)
    cost = np.minimum(np.rint(-np.log2(np.maximum(p, 1e-19)) * _UNIT), (1 << _COST_BITS) - 1).astype(np.uint32)
    return (follow << np.uint32(_COST_BITS) | cost).ravel()


def train(rows: list[tuple[str, bytes]], order: int = ORDER, least: int = LEAST) -> Model:
    """Language after language, so that one tree at a time is being built."""
    languages = sorted({lang for lang, text in rows if text})
    return Model(languages, [tree([t for lang, t in rows if lang == name], order, least) for name in languages])


def code_lengths(model: Model, texts: list[bytes], order: int = ORDER, chunk: int = CHUNK) -> np.ndarray:
    """Exact code lengths, in 1/256 bit: a row per text, a column per language."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(size) - size
    buffer = np.frombuffer(b"".join(texts) + b"\0" * (chunk + order), np.uint8)
    pieces = -(-size // chunk)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    warm = np.where(nth > 0, order, 0)
    start = begins[owner] + nth * chunk - warm
    length = np.minimum(chunk, size[owner] - nth * chunk) + warm
    by_length = np.argsort(-length, kind="stable")
    owner, warm, start, length = owner[by_length], warm[by_length], start[by_length], length[by_length]
    shift, mask = np.uint32(_COST_BITS), np.uint32((1 << _COST_BITS) - 1)
    for a in range(0, len(owner), 8192):
        n = length[a : a + 8192]
        cold = warm[a : a + 8192] == 0
        block = np.ascontiguousarray(buffer[start[a : a + 8192, None] + np.arange(n[0])].T)
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # chunks longer than each step
        for i, cells in enumerate(model.cells):
            state = np.zeros(len(n), np.uint32)
            total = np.zeros(len(n), np.int64)
            for t in range(int(n[0])):
                m = active[t]
                cell = cells[state[:m] << np.uint32(8) | block[t, :m]]
                step = cell & mask
                total[:m] += step if t >= order else np.where(cold[:m], step, 0)
                state[:m] = cell >> shift
            np.add.at(out[:, i], owner[a : a + 8192], total)
    return out


def sample(labelled: DataFrame, bound: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """About ``bound`` bytes of texts per language (columns id, lang, text), chosen by a hash of id and text.

    Languages are taken to be few. One pass sizes them and finds each one's first text by hash, which is always in the sample;
    another brings the texts whose hash falls under the language's rate. Copies under one id count once. A text
    longer than the bound teaches by its first ``bound`` bytes; what reaches the driver is below twice the bound per language.
    """
    rows = labelled.select("lang", "text", F.xxhash64("id", "text").alias("order"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("order").alias("first")).collect()
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * bound / r["bytes"]))])
    firsts = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["first"])])
    under = F.pmod("order", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    chosen = rows.filter(under | (F.col("order") == F.element_at(firsts, F.col("lang"))))
    chosen = chosen.select("lang", "order", F.substring(F.col("text").cast("binary"), 1, bound).alias("text"))
    chosen = chosen.groupBy("lang", "order").agg(F.first("text").alias("text"))
    before = Window.partitionBy("lang").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    sized = chosen.withColumn("used", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    found = sized.filter(F.col("used") < bound).collect()
    return [(r.lang, bytes(r.text)[: bound - r.used]) for r in sorted(found, key=lambda r: (r.lang, r.order))]


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None) -> Model:
    """A model of the labelled rows of ``docs`` (those of ``where``); rows without text or label teach nothing."""
    labelled = docs if where is None else docs.filter(where)
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text <> ''")
    return train(sample(labelled))


def predict(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"], text: str = "text") -> DataFrame:  # noqa: B006
    """The ``keep`` columns, lang_pred and score (the posterior of the code lengths under equal priors) per row.

    Null texts and texts without letters get ``und`` and 0, as does everything if nothing was learned.
    """
    for_python(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).cast("binary").alias("__llm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [t or b"" for t in b.column(len(keep)).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model.languages and len(texts):
                bits = code_lengths(model, texts) / _UNIT
                gap = bits - bits.min(axis=1, keepdims=True)
                scores = np.where([bool(t) for t in texts], 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1), 0)
                names = [model.languages[i] if t else UNKNOWN for i, t in zip(bits.argmin(axis=1), texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from rows whose crc32(id) mod 4 is not 2; predict all: id, held_out, lang_pred, score.

    Null texts and texts without letters get ``und`` and 0, as does every text where nothing can be learned. Repeated rows come
    out as often as they go in, an empty table gives none, and of several equally short codes the first language by name wins.
    """
    held_out = bucket_of(id_col, 4) == 2
    model = fit(docs, id_col, text, lang, ~held_out)
    found = predict(docs, model, [id_col], text)
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or less likely than ``least``.

    All columns stay as they are; a column that would clash with the working columns is not touched. Rows with null texts go,
    repeated rows are judged each, and an empty table stays empty.
    """
    model = fit(docs, id_col, text, lang, bucket_of(id_col, 4) != 2)
    marked = docs.select(*[F.col(c).alias(f"__llm_{i}") for i, c in enumerate(docs.columns)])
    own = f"__llm_{docs.columns.index(text)}"
    found = predict(marked, model, marked.columns, own).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"__llm_{i}").alias(c) for i, c in enumerate(docs.columns)])
