"""Operators against plain brute-force versions on small fixtures."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
import xxhash

from sitelens.llm import decontaminate, entries, line_dedup, pii, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, spans string"


def table(spark, texts, **more):
    rows = [(i, t, None, "h", None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# -- decontamination ---------------------------------------------------------


def slow_hits(text, items, width=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item)
        n = min(width, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "Cé", "d4"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 14, 20, 40])))) for i in range(12)]
    texts = [" ".join(rng.choices([*vocab, "zz", "zz-a"], k=rng.randrange(80))) for _ in range(60)]
    texts += [f"x {items[k][1]}. y {items[k][1]}" for k in range(12)] + [None, "", "  ", items[5][1].upper()]
    items = [x for x in items if len(x[1].split()) != 1] + [(99, None), (7, "zz")]  # one word alone is a window too
    docs = table(spark, texts)
    for block, items in ((decontaminate.BLOCK_BYTES, items), (60, items), (decontaminate.BLOCK_BYTES, items[:-1])):
        bench = spark.createDataFrame(items, "item_id long, text string")
        old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block
        got = {r.doc_id: r for r in decontaminate.judged(decontaminate.search(docs, bench)).collect()}
        decontaminate.BLOCK_BYTES = old
        for i, t in enumerate(texts):
            n, hit, names = slow_hits(t, items)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names)), t
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_of_real_rows(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in decontaminate.judged(decontaminate.search(docs, spark.createDataFrame(items, "item_id long, text string"))).collect():
        assert (r.n_words, r.n_hit) == slow_hits(texts[r.doc_id], items)[:2]


def test_empty_inputs(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(decontaminate.search(table(spark, ["a b"]), bench)).collect()[0].n_hit == 0
    assert decontaminate.search(none, bench).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert line_dedup.drop_boilerplate(none).count() == 0
    assert pii.pseudonymise(none, "k").count() == 0


# -- SimHash -----------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def slow_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_matches_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " \n", "one", "one  Two", "ONE two three four", "é É x y z"]
    fps = [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)
    kept = simhash.keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(fps)))


@pytest.mark.parametrize(("size", "rounds", "long"), [(30, 64, 4096), (300, 64, 4096), (700, 64, 4096), (700, 2, 60), (700, 0, 60)])
def test_bucket_links_connect_as_all_pairs_do(size, rounds, long, monkeypatch):
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "LONG", long)
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    while len(fps) < size:
        f = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    a, b = simhash.links(np.zeros(len(fps), np.int64), fps)
    at = {int(f): i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(label)
        for x, y in zip(a, b):
            i, j = at[int(x)], at[int(y)]
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = at[x], at[y]
        assert label[i] == label[j]
    assert label == slow_components([int(f) for f in fps])


def test_a_long_bucket_of_strangers_loses_no_link():
    """30,000 fingerprints that share 27 bits, among them 40 planted pairs."""
    rng = np.random.default_rng(5)
    fps = np.unique((rng.integers(0, 2**37, 30_000, dtype=np.uint64) << np.uint64(27)) | np.uint64(77))
    planted = {(int(f), int(f) ^ sum(1 << int(b) for b in rng.choice(np.arange(27, 64), 4, replace=False))) for f in fps[:: len(fps) // 40]}
    fps = np.unique(np.concatenate([fps, np.array([q for _, q in planted], np.uint64)]))
    a, b = simhash.links(np.zeros(len(fps), np.int64), fps)
    near = set()  # all pairs, by one fingerprint against all
    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 4]:
            if g != f:
                near.add((min(int(f), int(g)), max(int(f), int(g))))
    assert {(min(p), max(p)) for p in planted} <= near
    group = {int(f): int(f) for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (min(x, y), max(x, y)) in near
        group[root(x)] = root(y)
    assert all(root(x) == root(y) for x, y in near)


def test_fingerprints_of_long_texts():
    words = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    assert simhash.fingerprint(words.encode(), 4) == slow_fingerprint(words)


# -- secrets -----------------------------------------------------------------


def slow_base(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, k, n, p in (("access", 1, 16, "AKIA[A-Z0-9]+"), ("hex", 2, 32, "[0-9a-f]+")):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return ",".join(x[2] for x in sorted(out))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82, len(body) >> 8, len(body) & 255])
    return bytes([tag]) + size + body


def rsa_key():
    rng = random.Random(1)
    return der(0x30, der(2, b"\0"), *[der(2, b"\x01" + rng.randbytes(60)) for _ in range(8)])


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_secrets(spark, sf):
    key = base64.b64encode(rsa_key()).decode()
    token = ".".join([url64(json.dumps({"alg": "HS256"}).encode()), url64(b'{"sub": 1}'), "c2ln"])
    fake = ".".join([url64(b'{"typ": 1}'), url64(b'{"sub": 1}'), "c2ln"])
    part = lambda x: len(x).to_bytes(4, "big") + x
    ssh = base64.b64encode(b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"k" * 40) + part(b"p" * 80)).decode()
    texts = [
        f"é {token} x", fake, f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----", key, "MI" + key[3:-8] + "AAAA",
        ssh, ssh[:-40], rsa_key().hex(), "a" * 40, "PassWord = 'abcdefg' secret:12345678 AKIAABCDEFGHIJKL AKIA12", None, "", "toKen=abcdefgh" * 3,
    ]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(table(spark, texts))).collect()}
    kinds = [[s.split(":")[0] for s in got[i].spans.split(",")] for i in range(len(texts))]
    assert kinds[0] == ["jwt"] and got[0].spans == f"jwt:2:{2 + len(token)}"
    assert kinds[1] == [""] and kinds[2] == ["pem"] and kinds[3] == ["der"] and kinds[4] == [""]
    assert kinds[5] == ["ssh"] and kinds[6] == [""] and kinds[7] == ["hex", "der"] and kinds[8] == ["hex"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for r in secret_scan.digest(secret_scan.scan(table(spark, texts))).collect():
        assert r.base_sha256 == hashlib.sha256(slow_base(texts[r.doc_id] or "").encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in slow_base(texts[r.doc_id] or "").split(",") if x])


# -- PII ---------------------------------------------------------------------


def test_surrogates_keep_type_and_are_distinct(spark, sf):
    texts = [
        "Write to jo.Ann7@mail1.example.com or JO@x.example.com, call +1 (017) 555-7713.",
        "Again jo.Ann7@mail1.example.com; host 10.0.0.7 and 97.51.17.173, card 4111 1111 1111 1111 or 4111111111111112.",
        "Mrs. Anna Smith met Mr Smith and Господин Иванов", None, "", "nothing here 1.2.3 12345",
    ]
    out = {r.doc_id: r for r in pii.pseudonymise(table(spark, texts), "k").collect()}
    assert [out[i].n_entities for i in range(6)] == [3, 5, 3, 0, 0, 0]
    assert out[3].text is None and out[4].text == "" and out[5].text == texts[5]
    first, second, third = out[0].text, out[1].text, out[2].text
    mail = re.search(r"[\w.]+@\S+?\.com", first)[0]
    assert re.fullmatch(r"[a-z]{2}\.[A-Z][a-z]{2}\d@[a-z]{4}\d\.[a-z]{7}\.com", mail) and mail in second
    assert "jo.Ann7" not in first and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", first) and "555-7713" not in first
    assert re.search(r"host 10\.\d+\.\d+\.\d+ and \d+\.\d+\.\d+\.\d+,", second)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    cards = re.search(r"card (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15})\.", second)
    assert luhn(cards[1].replace(" ", "")) and not luhn(cards[2])
    m = re.fullmatch(r"Mrs\. (\w+na) (\w+) met Mr (\w+) and Господин ([А-Яа-я]+)", third)
    assert m[2] == m[3] != "Smith" and m[4] != "Иванов"
    assert {r.text for r in pii.pseudonymise(table(spark, texts), "other").collect()} != {r.text for r in out.values()}


def test_collisions_are_drawn_again(spark, monkeypatch):
    real = pii.surrogate

    def crowded(entity, key="k", draw=None):
        from pyspark.sql import functions as F

        d = F.lit(0) if draw is None else draw
        return F.when(d < 2, F.lit("10.9.9.9")).otherwise(real(entity, key, d))

    monkeypatch.setattr(pii, "surrogate", crowded)
    texts = [f"host 97.51.17.{i} and 97.51.17.{i % 3}" for i in range(9)]
    out = [r.text for r in pii.pseudonymise(table(spark, texts), "k").orderBy("doc_id").collect()]
    ips = [re.findall(r"\d+\.\d+\.\d+\.\d+", t) for t in out]
    assert len({x[0] for x in ips}) == 9
    assert all(ips[i][1] == ips[i % 3][0] for i in range(9))


# -- line dedup --------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nmenu\n\nmenu" if i < 6 else f"own {i}\nrare", "a") for i in range(10)]
    rows += [(20 + i, "menu\nx", "b") for i in range(4)] + [(30, None, None), (31, "", "a"), (32, "menu", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS bad", "2 AS n_lines", "3 AS host")
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, counted=True, min_pages=5, ratio=0.5).collect()}
    assert out[0].text == "own 0\n" and out[0].n_lines == 4 and out[0].n_dropped == 2 and out[0].bad == 1
    assert out[7].text == "own 7\nrare" and out[20].text == "menu\nx"
    assert out[30].text is None and out[31].text == "" and out[32].text == "menu"


def test_registered_queries_run(spark, sf):
    for name, query in entries.queries().items():
        assert query(spark, sf).count() > 0, name


def test_one_row_of_each_group_stays_with_odd_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words), (1, words), (1, words), (None, "quite another text than that"), (None, "quite another text than that"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS fp")
    kept = simhash.keep_one(docs)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 7] and kept.columns == docs.columns
