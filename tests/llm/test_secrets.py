"""Keys and tokens in the forms that a plain pattern misses, and what only looks like one."""

import base64
import json

import pytest

from sitelens.llm.secret_scan import spans


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


ZERO = der(2, b"\0")
RSA = der(0x30, ZERO, *[der(2, bytes([i + 1]) * 128) for i in range(8)])
SEC1 = der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, bytes.fromhex("06082a8648ce3d030107")))
LOCKED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"salt" * 4))), der(4, b"\xfb\xef\xff" * 40))
DIGEST = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, bytes(40)))
PUBLIC = der(0x30, der(0x30, der(6, bytes.fromhex("2a8648ce3d0201"))), der(3, b"\0" + bytes(64)))


def ssh():
    text = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(b"p" * 51) + text(b"s" * 136)


def url(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def wrapped(b, width=64, line="\n"):
    t = base64.b64encode(b).decode()
    return line.join(t[i : i + width] for i in range(0, len(t), width))


def der_spans(text):
    return [s for s in spans(text) if s[0] in ("der", "ssh")]


@pytest.mark.parametrize("key", [RSA, SEC1, LOCKED])
def test_keys_in_every_form(key):
    plain = base64.b64encode(key).decode()
    for form in (plain, wrapped(key), wrapped(key, 76, "\r\n"), wrapped(key, 64, "\n  "), url(key), key.hex(), key.hex().upper()):
        for before, after in (("", ""), ("key: ", " end"), ("/", ""), ('"', '"'), ("é\n", "\nnext line of text")):
            text = before + form + after
            assert [s[1:] for s in der_spans(text) if s[0] == "der"] == [(len(before), len(before) + len(form))], (form[:20], before, after)
    # Behind other hex digits, and two in a row.
    assert der_spans("00ff" + key.hex() + key.hex() + "ab") == [("der", 4, 4 + 2 * len(key)), ("der", 4 + 2 * len(key), 4 + 4 * len(key))]


def test_openssh_containers():
    for form in (base64.b64encode(ssh()).decode(), wrapped(ssh(), 70), url(ssh())):
        assert der_spans(f"a {form}\nb") == [("ssh", 2, 2 + len(form))]
    assert der_spans(base64.b64encode(ssh()[:-9]).decode()) == []


@pytest.mark.parametrize("header", ['{"alg":"HS256"}', '{ "alg": "none" }', '{\n  "alg": "RS256"\n}', ' {"alg":"x"}', '\n{"typ":"JWT","alg":"ES256"}', '\t\r{"alg":"x"}'])
def test_tokens_however_their_header_is_spaced(header):
    token = f"{url(header.encode())}.{url(json.dumps({'sub': 1}).encode())}.c2ln"
    assert ("jwt", 5, 5 + len(token)) in spans(f"see: {token}, ok")


def test_what_only_looks_like_a_key():
    for data in (DIGEST, PUBLIC, RSA[:-5], b"\x30\x82\xff\xff\x02\x01\x00" + bytes(100), bytes(range(48, 240))):
        for form in (base64.b64encode(data).decode(), url(data), data.hex(), wrapped(data)):
            assert der_spans(form) == [], form[:30]
    assert spans("example.words.here Many.dotted.words eyJhbGciOjF9.eyJhIjoxfQ.x " + "M" * 500 + " " + "30" * 300)[0][0] == "hex"
    assert der_spans("x" + base64.b64encode(RSA).decode()) == []  # no key begins inside a word
