"""Cases that shortcuts of the operators once lost."""

import base64
import re

from sitelens.llm import decontaminate, pii, secret_scan, simhash


# -- secrets -----------------------------------------------------------------


def test_short_private_keys_in_bare_base64(spark):
    # SEC1 with P-256 (121 bytes) and PKCS#8 with Ed25519 (48 bytes): lengths of one byte.
    curve, point = bytes.fromhex("a00a06082a8648ce3d030107"), b"\xa1\x44\x03\x42\x00\x04" + bytes(range(64))
    sec1 = b"\x30\x77\x02\x01\x01\x04\x20" + bytes(range(32)) + curve + point
    pkcs8 = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))
    public = bytes.fromhex("3059301306072a8648ce3d020106082a8648ce3d030107034200") + b"\x04" + bytes(range(64))
    keys = [base64.b64encode(k).decode() for k in (sec1, pkcs8, public)]
    assert keys[0].startswith("MHcCAQEEI") and len(keys[0]) == 164 and keys[1].startswith("MC4CAQAwBQYDK2Vw") and len(keys[1]) == 64
    texts = [f"é {keys[0]} x", keys[1], keys[2], "M" * 64]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in secret_scan.digest(secret_scan.scan(rows)).orderBy("doc_id").collect()]
    assert got[0] == "der:2:166" and got[1] == "der:0:64" and got[2:] == ["", ""]


def test_odd_candidates(spark):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    nested = part(b'{"alg":"x"}') + "." + part(b"[" * 200_000) + ".sig"
    sec1 = b"\x30\x77\x02\x01\x01\x04\x20" + bytes(range(32)) + bytes.fromhex("a00a06082a8648ce3d030107") + b"\xa1\x44\x03\x42\x00\x04" + bytes(range(64))
    junk = "-----BEGIN RSA PRIVATE KEY-----\nENCRYPTED junk\n-----END RSA PRIVATE KEY-----"
    old = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n{}\n-----END RSA PRIVATE KEY-----"
    whole, broken = old.format(base64.b64encode(bytes(64)).decode()), old.format(base64.b64encode(bytes(65)).decode())
    texts = [nested, sec1.hex().upper(), junk, whole, broken, sec1.hex()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in secret_scan.digest(secret_scan.scan(rows)).orderBy("doc_id").collect()]
    assert "der:0:242" in got[1].split(",") and [got[0], *got[2:]] == ["", "", f"pem:0:{len(whole)}", "", "hex:0:242,der:0:242"]


# -- rows with null and repeated ids -------------------------------------------


def texts_of(n):
    return [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(n)]


def test_rows_of_one_id_with_different_texts_are_told_apart(spark):
    a, b, c, d = texts_of(4)
    rows = [(0, a), (1, a), (1, b), (None, c), (None, d), (2, d), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "2 AS none"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()) == [(-1, c), (0, a), (1, b), (2, d)]
    assert kept.columns == ["doc_id", "text", "row", "none"]


def test_contaminated_rows_go_alone(spark, monkeypatch):
    a, b, c, d = texts_of(4)
    rows = [(None, a), (None, b), (1, c), (1, a), (1, d), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (2, c)], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        clean = decontaminate.drop_contaminated(docs, items)
        assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == [(-1, b), (1, d), (2, "")]


# -- PII -----------------------------------------------------------------------


def test_crowded_forms_get_free_values(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_DRAWS", 1)
    locals_ = [*"abcdefghijklmnopqrstuvwxyz", "ő", "ű"]  # 28 for 26 letters
    entities = [f"{c}@x.example.com" for c in locals_] + [f"192.168.{i // 250}.{i % 250}" for i in range(3000)]
    entities += [f"+1 {i:02d} 00" for i in range(100)] + [f"+1 00 {i:02d}" for i in range(1, 100)]
    known = spark.createDataFrame([(e,) for e in entities], "entity string")
    new = {r.entity: r.surrogate for r in known.select("entity", pii.surrogate(known.entity, "k").alias("surrogate")).collect()}
    over = {r.entity: r.surrogate for r in pii.redrawn(known, "k").collect()}
    new |= over
    assert over and set(new) == set(entities) and len(set(new.values())) == len(entities) and not set(new.values()) & set(entities)
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+", new[e]) for e in entities if e.startswith("192"))
    assert all(re.fullmatch(r"\+1 \d\d \d\d", new[e]) for e in entities if e.startswith("+"))
    lengths = sorted(len(new[e].split("@")[0]) for e in entities if "@" in e)
    assert lengths == [1] * 26 + [2] * 2


def test_one_number_written_in_two_ways(spark):
    rows = spark.createDataFrame([("+1 (017) 555-7713",), ("+1 017.555.7713",)], "entity string")
    a, b = [re.sub(r"\D", "", r.s) for r in rows.select(pii.surrogate(rows.entity, "k").alias("s")).collect()]
    assert a == b != "10175557713"


def replaced(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(rows, key).collect()}


def test_short_addresses_stay_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    for locals_ in (list(letters), [a + b for a in letters for b in letters]):
        out = replaced(spark, [f"to {x}@mail.com" for x in locals_])
        new = [r.text for r in out.values()]
        assert len(set(new)) == len(locals_) and not set(new) & {f"to {x}@mail.com" for x in locals_}
        assert all(re.fullmatch(r"to [a-z]+@[a-z]{4}\.com", x) for x in new)


def test_many_surnames_stay_apart_and_shared(spark):
    names = spark.range(5000).selectExpr("concat('Mr ', initcap(translate(hex(id + 1000000), '0123456789ABCDEF', 'qwrtzpsdfghjklyx'))) AS entity")
    over = {r.entity: r.surrogate for r in pii.redrawn_entities(names, "k").collect()}
    new = {r.entity: over.get(r.entity, r.s) for r in names.withColumn("s", pii.surrogate(names.entity, "k")).collect()}
    assert over and len(set(new.values())) == 5000 and not set(new.values()) & set(new)
    # A surname that was drawn again is the same behind every title and given name.
    some = sorted(over)[:5]
    full = spark.createDataFrame([(e.replace("Mr ", "Mrs Anna "),) for e in some], "entity string").unionByName(names)
    again = {r.entity: r.surrogate for r in pii.redrawn_entities(full, "k").collect()}
    for e in some:
        assert again[e.replace("Mr ", "Mrs Anna ")].split(" ")[-1] == again[e].split(" ")[-1]


def test_every_mention_of_a_name_goes(spark):
    texts = ["Mr John Smith wrote. John Smith and Smith came; Smithson, blacksmith and Johnny stayed. Mrs Smith too.", "Smith alone is left", "Herr Müller, Müller."]
    out = replaced(spark, texts)
    assert "John " not in out[0].text and not re.search(r"\bSmith\b", out[0].text)
    m = re.fullmatch(r"Mr (\w+) (\w+) wrote\. (\w+) (\w+) and (\w+) came; Smithson, blacksmith and Johnny stayed\. Mrs (\w+) too\.", out[0].text)
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] == m[6]
    assert out[1].text == texts[1] and out[1].n_entities == 0
    m = re.fullmatch(r"Herr (\w+), (\w+)\.", out[2].text)
    assert m[1] == m[2] != "Müller"


def test_further_forms(spark):
    texts = [
        "call 555-123-4567 or 555.123.4567", "Amex 3782 822463 10005 and 378282246310005", "run 1234567890123 and 4222222222222 of 13",
        "from 2001:db8:0:1:1:2:3:4 and fe80::1:2b, not 12:30:45 or a::b::c", "19-digit 6304000000000000000 1", "ID 12345678901234567890",
    ]
    out = replaced(spark, texts)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    a, b = re.fullmatch(r"call (\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4})", out[0].text).groups()
    assert a.replace("-", ".") == b != "555.123.4567" and out[0].n_entities == 2
    a, b = re.fullmatch(r"Amex (3\d{3} \d{6} \d{5}) and (3\d{14})", out[1].text).groups()
    assert a.replace(" ", "") == b != "378282246310005" and luhn(b)
    assert out[2].n_entities == 1 and out[2].text.startswith("run 1234567890123 and 4") and "4222222222222" not in out[2].text
    m = re.fullmatch(r"from ([0-9a-f:]+) and (fe80::[0-9a-f]:[0-9a-f]{2}), not 12:30:45 or a::b::c", out[3].text)
    assert m and m[1] != "2001:db8:0:1:1:2:3:4" and [len(x) for x in m[1].split(":")] == [4, 3, 1, 1, 1, 1, 1, 1]
    assert out[5].text == texts[5] and out[5].n_entities == 0
