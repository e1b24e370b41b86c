"""WARC archives, vector codes and conversation repair against plain versions and round trips."""

import gzip
import hashlib
import heapq
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from sitelens.llm import conversation_repair, entries, vector_codes, warc

# -- WARC ----------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, n int, archive string, salt_ int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], PAGES)


def odd_pages():
    same, other = "é" * 50, "b" * 100
    rows = [(7, "http://a/1", same), (3, "http://a/2", same), (5, None, same), (None, "http://a/3", same), (9, "http://a/4", "short"), (8, "http://a/5", "short")]
    rows += [(1, "http://a b/\r\nWARC-Type: x", other), (1, "http://a/6", other), (1, "http://a/6", other), (2, "", other), (4, "u", None), (6, "v", ""), (None, None, "c" * 300), (None, "w", "c" * 300)]
    return [*rows, (10, "http://long/", "\r\n\r\nWARC/1.1\r\n" * 200_000), (11, "z", "a" * 99), (12, "z", "a" * 99)]


def slow_records(rows):
    told = []
    for page, _, html in rows:
        body = (html or "").encode()
        ids = sorted((x[0] for x in rows if (x[2] or "") == (html or "")), key=lambda i: (i is None, i or 0))
        first = len(body) < 100 or (page == ids[0] and (page, html) not in [t[:2] for t in told])
        told.append((page, html, len(body), hashlib.sha256(body).hexdigest(), "response" if first else "revisit", None if first else ids[0]))
    return sorted((t[0] is None, t[0] or 0, *t[2:5], t[5] is None, t[5] or 0) for t in told)


def as_read(rows):
    return sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to is None, r.refers_to or 0) for r in rows)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_archives_round_trip(spark, tmp_path, monkeypatch, limit):
    """Nulls, repeated rows, URLs that would break headers; with lookups that are sent and ones that are joined."""
    monkeypatch.setattr("sitelens.llm.shared.BROADCAST_ROWS", limit)
    rows = odd_pages()
    index = warc.write(pages(spark, rows).repartition(3), f"file://{tmp_path}")
    read = warc.read(index).collect()
    assert as_read(read) == slow_records(rows)
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for *_, h in rows}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in read if r.record_type == "response")
    assert all(r.payload is None for r in read if r.record_type == "revisit")
    assert {(r.page_id, r.url) for r in index.collect()} == {(p, u) for p, u, _ in rows}
    # Whole archives are plain WARC: every member decompresses alone, and together they are the file.
    for archive in Path(tmp_path, "archives").glob("*.warc.gz"):
        whole = gzip.decompress(archive.read_bytes())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        own = sorted((r.offset, r.length) for r in index.collect() if r.archive.endswith(archive.name))
        assert sum(n for _, n in own) + own[0][0] == archive.stat().st_size
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_chosen_records_and_refusals(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " * 80) for i in range(200)]
    index = warc.write(pages(spark, rows), f"file://{tmp_path}")
    chosen = warc.read(index.filter("page_id % 50 = 3"))
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in chosen.collect()) == [(i, f"{i} " * 80) for i in (3, 53, 103, 153)]
    assert warc.read(index.limit(0)).count() == 0
    archive = next(Path(tmp_path, "archives").glob("*.warc.gz"))
    member = archive.read_bytes()[: [r.offset for r in index.filter(f"archive LIKE '%{archive.name}'").orderBy("offset").take(1)][0]]
    with pytest.raises((ValueError, zlib.error)):
        warc.parsed(member[:-3])
    with pytest.raises(ValueError):
        warc.parsed(member + member)
    assert warc.parsed(member)[0]["WARC-Type"] == "warcinfo"
    with pytest.raises(ValueError, match="digest|whole"):
        flawed = gzip.decompress(warc.record("1", "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), False, None, "now")).replace(b"payload\r\n", b"pAyload\r\n")
        warc.parsed(zlib.compress(flawed, wbits=31))


def test_ranges_coalesce():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5), ("a", 100 + 3 * warc.GAP_BYTES, 5), ("b", 0, 5), ("b", 5, 2 * warc.RANGE_BYTES), ("b", 5 + 2 * warc.RANGE_BYTES, 1)]
    assert [(a, len(r)) for a, r in warc.ranges(iter(places))] == [("a", 3), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]
    assert list(warc.ranges(iter([]))) == []


def test_small_archives_roll_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 0)
    shelf = warc._Shelf(f"file://{tmp_path}", "now")
    places = [shelf.add(b"x" * 5) for _ in range(3)]
    shelf.close()
    assert len({a for a, _ in places}) == 3 and len(list(Path(tmp_path).iterdir())) == 3


def test_no_pages(spark, tmp_path):
    assert warc.read(warc.write(pages(spark, []), f"file://{tmp_path}")).count() == 0


# -- vector codes --------------------------------------------------------------


def slow_codes(rows, parts=16):
    """The same in Python's integers."""
    kept = [(i, [int(x * 256 // 1) if abs(x) < 2.0**1000 else int(x) * 256 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : p * width + width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), k) for k, c in enumerate(books[p]))
    for _ in range(2):
        groups = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                groups[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(gs, b)] for gs, b in zip(groups, books)]
    out, total = [], {}
    for i, v, lab in kept:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        total[lab] = total.get(lab, 0) + error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    fits = lambda n: n if n < 2**63 else None
    bad = {lab for _, lab, _, e in out if e >= 2**63}
    return sorted(((i, c, fits(e), None if lab in bad else fits(total[lab]), sha) for i, lab, c, e in out), key=str)


@pytest.mark.parametrize(("scale", "width", "limit"), [(0.4, 2, 10_000), (1e5, 2, 0), (3e9, 1, 10_000), (1e38, 1, 10_000), (1e305, 1, 10_000)])
def test_codes_match_brute_force(spark, monkeypatch, scale, width, limit):
    monkeypatch.setattr("sitelens.llm.shared.BROADCAST_ROWS", limit)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(16 * width)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[4][1], 2), (500, None, 1), (501, [float("nan")] * 16 * width, 1), (502, [None] * 16 * width, 1), (503, [float("-inf")] * 16 * width, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "'x' AS vector", "2 AS code", "3 AS salt_").repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(frame).collect()), key=str)
    assert got == slow_codes(rows)


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    for most in (5, 2**20, 2**28, 2**30):
        x, y = (rng.integers(-most, most, (40, 7)) for _ in range(2))
        assert (vector_codes.dots(x, y) == x @ y.T).all()
    edge = np.array([[-(2**31), 2**31 - 1, -1]])
    assert vector_codes.dots(edge, edge)[0, 0] == 2**62 + (2**31 - 1) ** 2 + 1
    book = np.array([[[1], [1], [3]]])
    assert vector_codes.nearest(np.array([[[1]], [[2]]]), book)[0].tolist() == [[0], [0]]  # ties to the lower index


def test_no_vectors_and_ragged_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)]):
        out = vector_codes.compress(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 17, 1)], schema))


# -- conversations -------------------------------------------------------------


def slow_repair(codes):
    """Cheapest first over (row, state, letters): the first accepted end is the cheapest, least in ASCII among equals."""
    queue = [(0, "", 0, 0)]
    best = None
    while queue:
        cost, audit, row, state = heapq.heappop(queue)
        if best is not None and cost > best:
            break
        if row == len(codes) and state in (0, 3):
            return cost, audit
        if cost > 2 * len(codes):
            continue
        needed = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        to = {"u": 2, "a": 3, "s": 1}
        heapq.heappush(queue, (cost + 5, audit + "I", row, to[needed]))
        if row < len(codes):
            initial, fault = codes[row]
            heapq.heappush(queue, (cost + 2, audit + "D", row + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + 1 + more, audit + "R", row + 1, to[needed]))
                if initial == needed or (initial == "s" and state == 0):
                    heapq.heappush(queue, (cost + more, audit + "K", row + 1, to[initial]))
    raise AssertionError("deleting all rows is always possible")


def test_repairs_are_cheapest_and_least():
    faults = conversation_repair.FAULTS
    rng = random.Random(2)
    cases = [list(c) for n in range(4) for c in itertools.product([(i, f) for i in "suax" for f in ("none", "truncated")], repeat=n)]
    cases += [[(rng.choice("suaax"), rng.choice([*faults, "none", "none"])) for _ in range(rng.randrange(4, 9))] for _ in range(150)]
    for rows in cases:
        codes = "".join(conversation_repair.code_of(i, f) for i, f in rows)
        want = slow_repair(rows)
        for size in (1, 2, 3, 100):
            blocks = [codes[k : k + size] for k in range(0, len(codes), size)]
            cost, audit, left = conversation_repair.repaired(blocks)
            assert (cost, audit) == want, (rows, size)
            assert re.fullmatch("(s?(ua)+)?", "".join(" sua"[s] for s in left))


def test_insertions_where_they_pay(monkeypatch):
    """With insertions at 1 and other edits dear, they are used, and blocks still agree with the whole."""
    mended = {k: [[(letter, cost * 20, to) for letter, cost, to in own] for own in v] for k, v in conversation_repair._EDGES.items()}
    monkeypatch.setattr(conversation_repair, "_EDGES", mended)
    monkeypatch.setattr(conversation_repair, "INSERT", 1)
    monkeypatch.setattr(conversation_repair, "_PLAIN", conversation_repair.Weights(0))
    code = lambda roles: "".join(conversation_repair.code_of(r, "none") for r in roles)
    for roles, audit in (("ua", "KK"), ("uu", "KIKI"), ("aa", "IKIK"), ("s", "KII"), ("suau", "KKKKI"), ("", "")):
        for size in (1, 2, 9):
            codes = code(roles)
            assert conversation_repair.repaired([codes[k : k + size] for k in range(0, len(codes), size)])[1] == audit


def slow_conversations(rows):
    space = " \t\n\x0b\f\r"
    show = lambda x: " " if x is None else str(x)
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, show(role), show(text)))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        kept = []
        for turn, role, text in own:
            kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        seen, codes = set(), []
        for _, role, text in kept:
            bare = text.rstrip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
            seen.add((role, text))
            codes.append((role[:1], fault))
        turns = [t for t, *_ in kept if t is not None]
        cost, audit = slow_repair(codes) if codes else (0, "")
        lines, state, row = [], 0, 0
        for letter in audit:
            needed = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            role, text = ("", "") if letter == "I" else kept[row][1:]
            row += letter != "I"
            if letter != "D":
                name = role if letter == "K" else needed
                lines.append(f"{name}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[name[0]]
        count = lambda f: sum(x == f for _, x in codes)
        pairs = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), pairs, cost, audit, sha)
    return out


def test_conversations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 3)
    rng = random.Random(8)
    texts = ["Yes.", "No", "Why?", " \t\x0b", "", None, "é!", "Yes. \n", "a "]
    rows = []
    for conv in [*range(60), None]:
        turns = rng.sample(range(12), rng.randrange(1, 7)) + rng.choice([[], [None], [None, None]])
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for t in turns]
    rows += [rows[0], rows[0], rows[5]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS place", "'y' AS block", "1 AS copy", "2 AS plan").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(frame).collect()}
    assert got == slow_conversations(rows)


def test_conversations_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    small = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 10]
    want = slow_conversations(small)
    got = {r[0]: tuple(r)[1:] for r in entries.op13_conversation_repair(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    assert want and all(got[c] == w for c, w in want.items())


def test_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = conversation_repair.repair(frame).collect()[0]
    assert len(row.audit) == 3000 - sum(zlib.crc32(f"1:{i}".encode()) % 20 == 0 for i in range(3000)) + sum(zlib.crc32(f"1:{i}".encode()) % 20 == 3 for i in range(3000))
    assert conversation_repair.repair(frame.limit(0)).count() == 0
