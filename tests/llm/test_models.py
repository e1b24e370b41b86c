"""Learned operators, packing and the pipeline: exact round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sitelens.llm import decontaminate, fingerprint, langid, language_model, line_dedup, packing, simhash, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_brute import slow_components, slow_fingerprint  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score double, order long"


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), "h", None, "x", "y", 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# -- language ID -------------------------------------------------------------


def slow_bits(model_rows, text, languages, order, least):
    """Code length by walking the tree for every byte, with explicit exclusion."""
    out = []
    for lang in languages:
        counts, times = Counter(), Counter()
        for name, t in model_rows:
            if name == lang:
                for i in range(len(t)):
                    for k in range(min(order, i) + 1):
                        counts[t[i - k : i], t[i]] += 1
                        times[t[i - k : i]] += 1
        contexts = {c for c, n in times.items() if n >= least}

        def dist(ctx):
            above = dist(ctx[1:]) if ctx else [1 / 256] * 256
            seen = {b: counts[ctx, b] for b in range(256) if counts[ctx, b]}
            if not seen:
                return above
            n, q = sum(seen.values()), len(seen)
            rest = sum(above[b] for b in range(256) if b not in seen)
            return [seen[b] / (n + q) if b in seen else above[b] / rest * q / (n + q) for b in range(256)]

        bits = 0
        for i, b in enumerate(text):
            k = max(k for k in range(min(order, i) + 1) if k == 0 or text[i - k : i] in contexts)
            bits += round(-math.log2(dist(text[i - k : i])[b]) * 256)
        out.append(bits)
    return out


def test_code_lengths_match_a_tree_walk():
    rng = random.Random(1)
    rows = [(lang, "".join(rng.choices(letters, k=300)).encode()) for lang, letters in (("a", "abcé "), ("b", "abxy "))]
    model = langid.train(rows, order=3, least=4)
    texts = ["".join(rng.choices("abcxyzé ", k=n)).encode() for n in (0, 1, 5, 40)]
    for chunk in (7, 512):
        got = langid.code_lengths(model, texts, order=3, chunk=chunk)
        for row, t in zip(got.tolist(), texts):
            assert row == pytest.approx(slow_bits(rows, t, model.languages, 3, 4), abs=len(t))


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if crc(i, 4) == 2]
    assert all(got[i].held_out == (crc(i, 4) == 2) and 0 <= got[i].score <= 1 for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98


def test_a_language_of_long_texts_is_learned_and_copies_count_once(spark):
    german, english = "der hund und die katze gingen über die straße " * 30_000, "the cat and the dog went over the road "
    texts = [german, german + "x", *[english * 20] * 50, "die straße und der hund", "the dog and the road"]
    langs = {i: "de" if i < 2 else "en" for i in range(52)}
    docs = spark.createDataFrame([(None if i > 20 else i, t, langs.get(i)) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    chosen = langid.sample(docs.filter("lang IS NOT NULL").withColumnRenamed("doc_id", "id"), bound=5000)
    assert {lang for lang, _ in chosen} == {"de", "en"}
    assert all(0 < sum(len(t) for name, t in chosen if name == lang) <= 5000 for lang in ("de", "en"))
    assert len({t for _, t in chosen}) <= 8
    model = langid.train(chosen)
    bits = langid.code_lengths(model, [t.encode() for t in texts[-2:]])
    assert [model.languages[i] for i in bits.argmin(axis=1)] == ["de", "en"]


def test_language_edge_cases(spark):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "123 !?", "é" * 5000] * 3
    langs = {i: ("en", "de")[i % 6] for i in range(18) if i % 6 < 2}
    got = langid.identify(table(spark, texts, langs)).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {i for i in range(18) if i % 6 in (2, 3, 4)}
    assert {r.lang_pred for r in langid.identify(table(spark, texts)).collect()} == {"und"}
    kept = langid.accept(table(spark, texts, langs))
    assert kept.columns == table(spark, []).columns and {r.doc_id % 6 for r in kept.collect()} <= {0, 1, 5}
    assert langid.identify(table(spark, [])).count() == 0


# -- language model ----------------------------------------------------------


def test_scores_beat_the_base_and_base_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {100001: None, 100002: "", 100003: "Zzzq unknownword THE"}
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    split = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in split.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, crc(i, 7) == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    held = [i for i in texts if crc(i, 7) == 2]
    assert sum(got[i].score for i in held) > 0.97 * sum(got[i].base_score for i in held)


def test_predictive_probabilities_sum_to_one(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(40)], k=60)) for _ in range(80)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(language_model, "CONTEXT_SHARE", 0.02)
    total, contexts = language_model.frequent_words(frame)
    assert total == 80 * 61 and language_model.END not in contexts[1:] and len(contexts) > 5
    pairs = language_model.count_pairs(frame, contexts)
    direct = Counter()
    at = {w: i + 1 for i, w in enumerate(contexts)}
    for t in texts:
        ws = [*t.split(), "\n"]
        for w, before in zip(ws, ["\n", *ws]):
            direct[w, at.get(before, 0)] += 1
    got = Counter()
    for r in pairs.collect():
        got.update({(r.word, int(u)): int(c) for u, c in zip(np.frombuffer(r.us, "<u4"), np.frombuffer(r.cs, "<i8"))})
    assert got == direct
    guess = language_model.count_totals(pairs, len(contexts))
    seated = language_model.cut(language_model.seatings(pairs, guess, 6, 3))
    totals = language_model.seated_totals(seated, guess, 3)
    rows = language_model.modelled(seated, totals, 3).collect()
    roots = np.array([np.frombuffer(r.root, "<f8") for r in rows])
    assert roots.sum(axis=0) + language_model.unknown_root(totals) == pytest.approx(np.ones(3))
    for u in range(len(contexts) + 1):
        mass = language_model.unseen(np.array([u]), language_model.unknown_root(totals)[None], totals)[0]
        for r, root in zip(rows, roots):
            own = dict(zip(np.frombuffer(r.us, "<u4").tolist(), np.frombuffer(r.lp, "<f8").tolist()))
            mass += 10 ** own[u] if u in own else language_model.unseen(np.array([u]), root[None], totals)[0]
        assert mass == pytest.approx(1)
    for r in seated.collect():
        ts = np.frombuffer(r.ts, "<u4").reshape(-1, 3)
        us, cs = np.frombuffer(r.us, "<u4"), np.frombuffer(r.cs, "<i8")
        inside = us > 0
        assert (ts[inside] >= 1).all() and (ts[inside] <= cs[inside, None]).all() and (ts[~inside] == 0).all()
        assert (np.frombuffer(r.rc, "<i8") == ts.sum(axis=0) + cs[~inside].sum()).all()


def slow_gibbs(counts, openings, direct, d, d0, root_opening, root_total, sweeps, seed):
    """Customer by customer, with every table: mean tables of each pair and of the root, over the later half of the sweeps."""
    rng = random.Random(seed)
    tables = {k: [1] * n for k, n in counts.items()}
    words = {w for w, _ in counts} | set(direct)
    root = {w: [direct.get(w, 0) + sum(len(t) for (v, _), t in tables.items() if v == w)] for w in words}

    def at_root(w, go):
        own = root[w]
        if go:
            k = rng.choices(range(len(own)), own)[0]
            own[k] -= 1
            if not own[k]:
                del own[k]
        else:
            k = rng.choices(range(len(own) + 1), [x - d0 for x in own] + [root_opening])[0]
            own.append(1) if k == len(own) else own.__setitem__(k, own[k] + 1)

    kept, kept_root = Counter(), Counter()
    for sweep in range(sweeps):
        for (w, u), own in tables.items():
            for _ in range(counts[w, u]):
                k = rng.choices(range(len(own)), own)[0]
                own[k] -= 1
                if not own[k]:
                    del own[k]
                    at_root(w, True)
                p = (sum(root[w]) - d0 * len(root[w]) + root_opening) / (1 + root_total)
                k = rng.choices(range(len(own) + 1), [x - d for x in own] + [openings[u] * p])[0]
                if k == len(own):
                    own.append(1)
                    at_root(w, False)
                else:
                    own[k] += 1
        for w in words:
            for _ in range(direct.get(w, 0)):
                at_root(w, True)
                at_root(w, False)
        if sweep >= sweeps // 2:
            kept.update({k: len(t) for k, t in tables.items()})
            kept_root.update({w: len(t) for w, t in root.items()})
    half = sweeps - sweeps // 2
    return {k: n / half for k, n in kept.items()}, {w: n / half for w, n in kept_root.items()}


def test_block_sweeps_agree_with_customer_by_customer_gibbs():
    counts = {(0, 1): 60, (0, 2): 20, (0, 3): 3, (1, 1): 2, (1, 2): 25, (2, 3): 40, (3, 1): 1}
    direct = {0: 5, 1: 10, 3: 2}
    customers = np.array([0.0, 63, 45, 43])
    totals = language_model.Totals(4, 168, (0.6, 0.4), customers, np.array([[4.0, 12, 12, 8]]), np.array([50.0]))
    rows = sorted({**counts, **{(w, 0): n for w, n in direct.items()}}.items())
    word, us = (np.array([k[i] for k, _ in rows]) for i in (0, 1))
    cs = np.array([n for _, n in rows])
    ts, rc, rt = language_model.sample_seatings(word, us, cs, 4, totals, 7, 1500, 1400)
    root_opening = (1 + 0.4 * 4.0) * totals.base
    openings = {u: 1 + 0.6 * totals.tables[0, u] for u in (1, 2, 3)}
    want, want_root = slow_gibbs(counts, openings, direct, 0.6, 0.4, root_opening, 50.0, 1500, 3)
    for (k, _), got in zip(rows, ts.mean(axis=0)):
        assert got == pytest.approx(want.get(k, 0), rel=0.1, abs=0.15), k
    assert rt.mean(axis=0) == pytest.approx([want_root[w] for w in range(4)], rel=0.15, abs=0.15)
    assert len({tuple(t) for t in ts}) > 1000  # seatings that are kept differ


def test_tables_of_many_customers_follow_the_exact_weights():
    top = 1500
    exact = language_model.log_stirling(0.6, top)
    for c in (65, 300, top):
        for opening, rest in ((0.01, np.inf), (0.5, np.inf), (20.0, np.inf), (900.0, np.inf), (0.2, 3.0), (30.0, 100.0)):
            t = np.arange(1, c + 1)
            weight = exact[c, 1 : c + 1] + t * np.log(opening) + np.concatenate(([0.0], np.cumsum(np.log1p(t[:-1] / rest))))
            weight = np.exp(weight - weight.max())
            mean = (weight * t).sum() / weight.sum()
            deviation = np.sqrt((weight * t**2).sum() / weight.sum() - mean**2)
            got = language_model.seat(np.full(2000, c), np.full(2000, opening), np.full(2000, rest), 0.6, np.random.default_rng(1))
            assert got.mean() == pytest.approx(mean, rel=0.12, abs=0.1), (c, opening, rest)
            assert got.std() == pytest.approx(deviation, rel=0.5, abs=0.1), (c, opening, rest)


def test_contexts_do_not_depend_on_how_texts_are_dealt(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], weights=[1 / (k + 1) for k in range(200)], k=40)) for _ in range(300)] + ["", "  a\t B "]
    counts = Counter(w for t in texts for w in [*t.lower().split(), "\n"])
    n = sum(counts.values())
    monkeypatch.setattr(language_model, "CONTEXT_SHARE", 0.005)
    want = sorted(w for w, k in counts.items() if k >= 0.005 * n)
    for size, parts in ((1, 1), (3000, 3), (6 << 20, 4)):
        monkeypatch.setattr(language_model, "BLOCK_BYTES", size)
        frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        assert language_model.frequent_words(frame) == (n, want)


def test_scores_are_plain_sums_over_the_model(spark, monkeypatch):
    """Over several families of rows, blocks and tasks, with long, empty, repeated and null texts and words never seen."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[k] for k in np.minimum(rng.geometric(0.02, rng.integers(0, 12)) - 1, 299)) for _ in range(2600)]
    texts[5], texts[1500], texts[1501] = None, " ".join(words * 40), "w1 W1 neverseen w1"
    texts[2599] = texts[2598]
    asked = {}
    scored = language_model._scored

    def recorded(docs, model, head, totals, contexts, kept):
        asked.update(model=model, totals=totals, contexts=contexts, head=head)
        return scored(docs, model, head, totals, contexts, kept)

    monkeypatch.setattr(language_model, "_scored", recorded)
    monkeypatch.setattr(language_model, "CONTEXT_SHARE", 0.002)
    monkeypatch.setattr(language_model, "HEAD_SHARE", 0.001)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(3, "doc_id")
    frame = language_model.cut(frame)
    got = {r.doc_id: r for r in language_model.score(frame).collect()}
    assert len(got) == len(texts)
    totals, number = asked["totals"], {w: i + 1 for i, w in enumerate(asked["contexts"])}
    assert len(number) > 50 and 0 < len(asked["head"].keys)
    pairs, roots, counts = {}, {}, {}
    for r in asked["model"].collect():
        counts[r.word], roots[r.word] = r.n, np.frombuffer(r.root, "<f8")
        pairs |= {(r.word, int(u)): v for u, v in zip(np.frombuffer(r.us, "<u4"), np.frombuffer(r.lp, "<f8"))}
    for i, text in enumerate(texts):
        tokens = [*(text or "").lower().split(), "\n"]
        want = base = 0.0
        for before, word in zip(["\n", *tokens], tokens):
            u = number.get(before, 0)
            if (word, u) in pairs:
                want += pairs[word, u]
            else:
                root = roots.get(word, language_model.unknown_root(totals))
                want += np.log10(language_model.unseen(np.array([u]), root[None], totals)[0])
            base += np.log10((counts.get(word, 0) + 1) / (totals.tokens + totals.words + 1))
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens), sum(w in counts for w in tokens))
        assert got[i].score == pytest.approx(want, rel=1e-9) and got[i].base_score == pytest.approx(base, rel=1e-9)


def test_rare_words_are_contexts(spark, monkeypatch):
    """With a short list of numbered words: a word's usual follower is likelier, and probabilities after each known word sum to one."""
    rng = random.Random(4)
    often = [f"f{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(60)]
    texts = [" ".join(w for k in rng.choices(range(60), k=8) for w in (rare[k], often[k % 12] if rng.random() < 0.8 else rare[k - 1])) for _ in range(150)]
    vocab = sorted({w for t in texts for w in t.split()})
    asked = ["r3", "r17", "never"]
    every = texts + [*vocab, "unknown", "never", *[f"{u} {w}" for u in asked for w in [*vocab, "unknown"]]]
    frame = language_model.cut(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").coalesce(1))
    monkeypatch.setattr(language_model, "CONTEXT_SHARE", 0.03)
    parts = {}
    rest_scored = language_model.rest_scored

    def recorded(*args):
        parts["contexts"], parts["found"] = args[3], rest_scored(*args)
        return parts["found"]

    monkeypatch.setattr(language_model, "rest_scored", recorded)
    rows = language_model.score(frame, held_out=language_model.F.col("doc_id") >= 150).collect()
    assert len(rows) == len(every) and language_model.END in parts["contexts"] and not set(asked) & set(parts["contexts"])
    got = {every[r.doc_id]: r.score for r in rows if r.doc_id >= 150}
    assert got["r3 f3"] > got["r3 f4"] + 0.5 and got["r17 f5"] > got["r17 f3"] + 0.5
    order = [r.doc_id for r in frame.select("doc_id").collect()]
    after = Counter()  # log10 of the tokens after words without a number
    for r in parts["found"].collect():
        for e in np.frombuffer(r.sums, language_model._SUMS):
            after[every[order[r.family * language_model.FAMILY + int(e["member"])]]] += float(e["score"])
    for u in asked:
        mass = 10 ** after[u]  # the end of the text
        for w in [*vocab, "unknown"]:
            mass += 10 ** (after[f"{u} {w}"] - after[w])
        assert mass == pytest.approx(1, rel=1e-6), u


def test_sweeps_of_a_rare_context_follow_the_exact_weights():
    c, root, d = np.array([4, 3, 1, 0]), np.array([0.2, 0.05, 0.1, 0.3]), 0.6
    exact = language_model.log_stirling(d, 8)
    weights = {}
    for a in range(1, 5):
        for b in range(1, 4):
            opened = sum(np.log(1 + d * i) for i in range(a + b + 1))
            weights[a, b] = np.exp(exact[4, a] + exact[3, b] + a * np.log(0.2) + b * np.log(0.05) + opened)
    total = sum(weights.values())
    want = [sum(k[i] * x for k, x in weights.items()) / total for i in (0, 1)]
    pairs = language_model.Rest(np.zeros(4), np.arange(4), c, np.zeros(4, int), np.zeros(0, int))
    t, rng, kept = np.minimum(c, 1), np.random.default_rng(2), []
    for _ in range(4000):
        pairs.sweep(t, root, d, rng)
        kept.append(t.copy())
    assert np.mean(kept, axis=0) == pytest.approx([*want, 1, 0], rel=0.04)


def test_messages_come_back_whole():
    rows = pa.RecordBatch.from_arrays([pa.array(["a", None, "ö" * 5000]), pa.array([b"", b"x", b"y" * 9]), pa.array([True, False, None])], ["s", "b", "t"])
    for part in (rows, rows.slice(1, 1), rows.slice(3)):
        message = language_model._written(part)
        assert language_model._read(pa.scalar(message)).to_pylist() == part.to_pylist()
        assert int.from_bytes(message[:8], "little") == len(pa.decompress(message[8:], int.from_bytes(message[:8], "little"), "zstd"))


@pytest.mark.parametrize("buckets", [7, 900, 5000])
def test_buckets_share_messages(spark, monkeypatch, buckets):
    """A block sends no more messages than there are groups, and every row arrives once, in its bucket."""
    groups = language_model.group_count(buckets)
    assert groups == (buckets if buckets < 192 else 4 * int(buckets**0.5) if buckets == 5000 else 192)
    monkeypatch.setattr(language_model, "APART_BYTES", 60_000)  # here, what waits goes to a file
    rng = np.random.default_rng(buckets)
    sent = []
    for kind in (0, 2, 0, 2):
        keys = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
        rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([str(k) * 3 for k in keys])], ["k", "s"])
        out = list(language_model._messages(kind, keys, buckets, rows))
        assert sum(b.num_rows for b in out) <= groups
        sent.append((kind, keys, out))
    arrived = sorted((m for _, _, out in sent for b in out for m in b.to_pylist()), key=lambda m: (m["bucket"], m["kind"]))
    batches = [pa.RecordBatch.from_pylist(arrived[i : i + 50], sent[0][2][0].schema) for i in range(0, len(arrived), 50)]
    found, order = Counter(), []
    for bucket, kind, table in language_model._arrived(iter(batches), buckets):
        order.append((bucket, kind))
        assert table.column_names == ["k", "s"]
        for k, s in zip(table["k"].to_pylist(), table["s"].to_pylist()):
            assert k % buckets == bucket and s == str(k) * 3
            found[kind, k] += 1
    assert found == Counter((kind, int(k)) for kind, keys, _ in sent for k in keys)
    met = [b for i, (b, _) in enumerate(order) if not i or order[i - 1][0] != b]
    assert len(met) == len(set(met)) and all(a[1] <= b[1] for a, b in zip(order, order[1:]) if a[0] == b[0])


def test_scores_with_groups_and_waves(spark, monkeypatch):
    """Groups of several buckets and sums in waves: as many rows, the same counts, and scores against the same plain sums."""
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 20)
    monkeypatch.setattr(language_model, "WAVE_TOKENS", 0)
    asked = []
    buckets = language_model.bucket_count
    monkeypatch.setattr(language_model, "bucket_count", lambda tokens: asked.append(buckets(tokens)) or asked[-1])
    monkeypatch.setattr(language_model, "let_go", lambda table: None)  # the model is looked at afterwards
    test_scores_are_plain_sums_over_the_model(spark, monkeypatch)
    assert language_model.group_count(asked[0]) < asked[0]
    monkeypatch.undo()
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 2)
    monkeypatch.setattr(language_model, "WAVE_TOKENS", 0)
    monkeypatch.setattr(language_model, "let_go", lambda table: None)
    test_rare_words_are_contexts(spark, monkeypatch)


def test_words_in_doubt_are_counted_whole(spark, monkeypatch):
    """Also the end of texts, in reports of every block size, and with empty and blank texts."""
    texts = ["A b  c ", "", " \t", "b b B x", "c c a end", "\x0bq\x0cA"] * 40
    counts = Counter(w for t in texts for w in [*t.lower().split(), "\n"])
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 1)
    for share in (0.1, 0.2, 0.3):
        monkeypatch.setattr(language_model, "CONTEXT_SHARE", share)
        for part in (0.5, 0.99):
            monkeypatch.setattr(language_model, "REPORT_PART", part)
            total, words = language_model.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"))
            assert (total, words) == (sum(counts.values()), sorted(w for w, n in counts.items() if n >= share * total))


def test_replies_go_to_places_of_pairs(spark):
    """Words without a number know where their pairs lie: bucket, and place in its Rest."""
    texts = [" ".join(random.Random(i).choices("abcdefghij", k=30)) for i in range(20)]
    docs = language_model.cut(spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "id % 4 = 0 AS held_out", "text"))
    rest = language_model.rest_tokens(docs, ["\n", "a", "b"], 5)
    pairs = {r.bucket: language_model.Rest.of(language_model._read(pa.scalar(bytes(r.payload)))) for r in rest.collect()}
    sent, _ = language_model.first_tables(rest, 0.5, 5, 4)
    found = []
    for r in sent.filter("kind = 1").collect():
        rows = language_model._read(pa.scalar(bytes(r.payload)))
        found += zip(*(rows[k].to_pylist() for k in ("w", "pair", "t")))
    assert len(found) == len({p for _, p, _ in found}) == sum(int((p.w >= language_model.KEYED).sum()) for p in pairs.values())
    for w, place, t in found:
        own, at = pairs[place >> 32], place & 0xFFFFFFFF
        assert own.w[at] == w and min(own.c[at], 1) <= t <= own.c[at]


def test_a_trial_needs_no_second_worker(spark, monkeypatch):
    """Pairs are seated and summed by one Python worker a task, with the totals of seatings that are written first."""
    frame = spark.createDataFrame([("a b a c b a " * 20,), ("c a b d",), ("d d a",)], "text string").coalesce(1)
    pairs = language_model.count_pairs(frame, ["\n", "a", "b"])
    guess = language_model.count_totals(pairs, 3)
    want = language_model.seated_totals(language_model.cut(language_model.seatings(pairs, guess, 4, 1)), guess, 1)
    plans = []
    mapped = language_model.mapped

    def seen(rows, work, schema):
        plans.append((out := mapped(rows, work, schema))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return out

    monkeypatch.setattr(language_model, "mapped", seen)
    got = language_model.seated_totals(pairs, guess, 1, 4)
    assert plans == [1]
    assert (got.tables == want.tables).all() and (got.root_customers == want.root_customers).all()


def test_language_model_of_nothing(spark):
    assert language_model.score(table(spark, [])).count() == 0
    for r in language_model.score(table(spark, [None, "a b", "a b"])).collect():
        assert r.n_tokens == (1 if r.doc_id == 0 else 3)


# -- packing -----------------------------------------------------------------


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    assert {r.doc_id for r in rows} == set(texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and own[-1].offset + own[-1].length <= 1024
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
    return len(by_sequence)


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER).collect()
    n = check_packing(rows, texts)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 2
    odd = [None, "", " ", "\n", "a  b", " x \n y", "a\n\nb\n c  \n d", "é é \x1c x <|endoftext|>", "word " * 3000, "tail ", "x\ty \r\n z", "don't   stop\n'll"]
    check_packing(packing.pack(table(spark, odd), TOKENIZER).collect(), dict(enumerate(odd)))
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing on counts: sequences of one content are handled together."""
    by_free: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = next((f for f in range(length, capacity) if by_free.get(f)), None)
            if free is None:
                each = min(capacity // length, left)
                bins = left // each
                by_free[capacity - each * length][(length,) * each] += bins
                left -= bins * each
                continue
            config, n = next(iter(by_free[free].items()))
            each = min(free // length, left)
            bins = min(n, left // each)
            by_free[free][config] -= bins
            if not by_free[free][config]:
                del by_free[free][config]
            by_free[free - each * length][config + (length,) * each] += bins
            left -= bins * each
    total: Counter = Counter()
    for group in by_free.values():
        total.update(group)
    return total


def check_plan(counts):
    """Every piece held once, no sequence too long, at most as many as best fit decreasing takes, not below the bound."""
    plan = packing.plan(dict(counts))
    assert all(sum(c) <= 1024 for c in plan.packed)
    held = Counter()
    for config, n in plan.packed.items():
        for x in config:
            held[x] += n
    assert held == Counter({k: n for k, n in counts.items() if n})
    assert plan.bound <= sum(plan.packed.values()) <= sum(best_fit_decreasing(dict(counts), 1024).values())
    return plan


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    check_plan(Counter(min(1024, int(rng.paretovariate(0.7) * 20)) for _ in range(rng.choice([1, 30, 3000]))))


SKEWED = [
    {600: 1000, 500: 700, 100: 300, 90: 50},
    {342: 900, 341: 500, 340: 30, 1: 5},
    {1024: 7},
    {1: 1},
    {},
    {37: 50_000, 411: 8_000, 1000: 3},
]


@pytest.mark.parametrize("counts", SKEWED)
def test_plans_of_skewed_lengths(counts):
    check_plan(counts)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_plans_of_the_given_tables(spark, sf):
    found = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), TOKENIZER)
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    check_plan(counts)
    check_plan({k: 25 * n for k, n in counts.items()})


def test_the_program_itself():
    """Rounds after the first, whose weights differ, take fewer sequences, and the bound is one."""
    few = {341: 900, 342: 500, 171: 700, 513: 300, 250: 1000, 130: 777}
    plan = check_plan(few)
    assert min(plan.rounds) == sum(plan.packed.values()) < plan.rounds[0] == sum(packing.plan(few, rounds=1).packed.values())
    assert plan.bound <= sum(plan.rounds) / len(plan.rounds)
    # Of 342 and 682, which fill a sequence together, there are as many sequences as pairs: met at once.
    assert packing.plan({342: 300, 682: 300}).rounds == [300] and packing.plan({342: 300, 682: 300}).bound == 300


# -- fingerprints ------------------------------------------------------------


def test_fingerprints(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pairs = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, "one"), (5000, "one"), (5000, "two")]
    for size in (10_000, 30, 2):
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
        frame = spark.createDataFrame(pairs, "doc_id long, text string")
        got = fingerprint.ranges(frame.selectExpr("doc_id AS id", "coalesce(text, '') AS text"), size)
        assert got.filter("NOT guest").count() == len(pairs)
        rows = fingerprint.fingerprints(frame).collect()
        order = sorted([(i, t or "") for i, t in pairs], key=lambda x: (-x[0], x[1].encode()))
        want = Counter()
        for k, (i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    own = {r.doc_id: r for r in rows}
    assert own[1000].fingerprint == own[1001].fingerprint and own[1002].near_next == 0 and own[1001].near_next == 1
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows])
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and fingerprint.fingerprints(frame.limit(0)).count() == 0
    nulls = fingerprint.fingerprints(spark.createDataFrame([(None, "a"), (2, "b"), (None, "b")], "doc_id long, text string")).collect()
    assert len(nulls) == 3


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(2)
    sampler = fingerprint.Sampler(2048)
    for _ in range(5):
        a = Counter(rng.choices([f"w{i}".encode() for i in range(60)], k=200))
        b = Counter(rng.choices([f"w{i}".encode() for i in range(30, 80)], k=120)) + Counter({k: v // 2 for k, v in a.items() if v > 1})
        want = sum((a & b).values()) / sum((a | b).values())
        x, y = sampler.signatures([a, b])
        assert fingerprint.likeness(x, y) == pytest.approx(want, abs=0.05)


def test_long_texts_and_full_groups_draw_as_short_ones_do(monkeypatch):
    rng = random.Random(4)
    bags = [Counter(f"w{int(rng.paretovariate(0.4)) % 5000}".encode() for _ in range(n)) for n in (3, 900, 0, 4000, 2500)]
    want = fingerprint.Sampler().signatures(bags)
    monkeypatch.setattr(fingerprint, "PART", 100)
    monkeypatch.setattr(fingerprint, "MEMORY", 700)
    assert (fingerprint.Sampler().signatures(bags) == want).all()
    monkeypatch.setattr(fingerprint, "LONG", 50)
    assert (fingerprint.Sampler().signatures(bags) == want).all()


# -- toxicity ----------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if crc(r.doc_id, 5) == 0}
    assert all(got[i].held_out for i in truth) and all(r.predicted == (r.score >= 0.5) for r in got.values())
    toxic = [got[i].predicted for i, y in truth.items() if y == 1]
    clean = [got[i].predicted for i, y in truth.items() if y == 0]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.03


def test_toxicity_shares_ngrams_and_takes_odd_input(spark):
    rng = random.Random(4)
    fill = [f"{a}{b}{c}" for a in "bcdf" for b in "aei" for c in ("st", "nd", "rk")]
    make = lambda bad: " ".join([*rng.choices(fill, k=30), *(["blockhead"] if bad else []), *rng.choices(fill, k=20)])
    texts = [make(i % 2) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(400)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    texts += [" ".join(fill[:20]) + " blockheadz", "", None, "!!! ...", "word " * 9000]
    got = {r.doc_id: r for r in toxicity.score(table(spark, texts), labels).collect()}
    assert got[400].predicted == 1 and got[401].score == got[402].score == got[403].score and got[401].predicted == 0
    none = toxicity.score(table(spark, ["a", None]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


# -- pipeline ----------------------------------------------------------------


def slow_pipeline(rows, items):
    """doc_id to text after the first four stages, by plain loops; rows: (doc_id, text, source), language known for all with letters."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    pages, on = Counter(r[2] for r in kept), Counter()
    for _, text, source in kept:
        on.update((source, line) for line in set(text.split("\n")) if line.strip(" "))
    bad = {k for k, n in on.items() if n >= 5 and n / pages[k[0]] > 0.1}
    kept = [(i, "\n".join(x for x in text.split("\n") if (source, x) not in bad)) for i, text, source in kept]
    kept.sort()
    label = slow_components([slow_fingerprint(t) for _, t in kept])
    kept = [kept[i] for i in sorted(set(label))]
    windows = {}
    for item in items:
        own = words(item)
        n = min(13, len(own))
        windows.setdefault(n, set()).update(tuple(own[i : i + n]) for i in range(len(own) - n + 1 if own else 0))
    out = {}
    for i, text in kept:
        ws, hit = words(text), set()
        for n, grams in windows.items():
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in grams:
                    hit.update(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(ws)):
            out[i] = text
    return out


def test_pipeline_matches_plain_loops(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = slow_pipeline(rows, items)
    check_packing(corpus_pipeline.run(spark, sf).collect(), want)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = line_dedup.cut(out)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) < set(texts)
    after_one = {r.doc_id for r in langid.accept(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all(any(c.isalpha() for c in texts[i].text) for i in after_one)
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, left)
    assert not decontaminate.judged(decontaminate.search(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).filter("contaminated").count()
    near = simhash.near_duplicates(docs)
    assert near.select("component_id").distinct().count() == near.count() == len(left)
