"""Compressed data of several members, and a test item whose id is the empty text."""

import base64
import bz2
import gzip
import random
import textwrap
import time
import zlib

import pytest

from meguri.llm import decontaminate, secrets


def inflated(data):
    return b"".join(secrets._inflated(iter([data])))


def test_all_members():
    for pack in (gzip.compress, bz2.compress, lambda d: gzip.compress(d)[:0] + bz2.compress(d)):
        data = pack(b"nothing here, only words") + pack(b" password = abcdefGHIJKL0123 ") + gzip.compress(b"api_key: QRSTUVwxyz9876543")
        spans = secrets.spans_of("see " + base64.b64encode(data).decode() + " there")
        assert sum(s["kind"] == "assign" and not s["base"] for s in spans) >= 1
        layer = inflated(data)
        assert b"abcdefGHIJKL0123" in layer and b"QRSTUVwxyz9876543" in layer
        for step in (1, 2, 7):
            assert b"".join(secrets._inflated(data[i : i + step] for i in range(0, len(data), step))) == layer
    assert inflated(gzip.compress(b"abc") + b"tail") == b"abc"
    assert inflated(b"plain") == b""


def assigned(data):
    text = f"see {base64.b64encode(data).decode()} there"
    return [(s["kind"], s["way"]) for s in secrets.spans_of(text) if s["kind"] == "assign" and not s["base"]]


@pytest.mark.parametrize("pack, filler, size", [
    (gzip.compress, b"some words go on, and on\n", 18_000_000), (zlib.compress, "é, là ".encode(), 40_000_000), (bz2.compress, b"x", 18_000_000),
])
def test_secret_behind_much_data(pack, filler, size):
    assert assigned(pack(filler * (size // len(filler)) + b" api_key = abcdefGHIJKL0123")) == [("assign", "base64/compressed/")]


def test_windows_are_cut_where_nothing_lies_across(monkeypatch):
    rng = random.Random(5)
    inner = textwrap.wrap(base64.b64encode(b"words and words, then password = abcdefGHIJKL0123 and more words").decode(), 24)
    for n in range(60):
        monkeypatch.setattr(secrets, "WINDOW", rng.randint(20, 200))
        filler = lambda: " ".join("".join(rng.choice("abcé.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))
        for said in ('token   =   "abcdefghijkl0', "\n".join(inner), "&#x41;&#x4b;&#x49;&#x41;" + "A" * 16, "0123456789abcdef" * 4):
            text = f"{filler()}\n{said}\n{filler()}"
            parts = list(secrets._windows(text.encode()[i : i + 5] for i in range(0, len(text.encode()), 5)))
            assert "".join(parts) == text and sum(said in p for p in parts) == 1


def test_layers_that_are_no_plain_text():
    assert assigned(b"password=\0 api_key = abcdefGHIJKL0123") == [("assign", "base64/")]
    assert assigned(b"\xff\xfe\x01 caf\xe9 api_key = abcdefGHIJKL0123 \xff") == [("assign", "base64/")]
    # looks like compressed data, and is none; damaged at its end
    assert assigned(b"x\x9c no, api_key = abcdefGHIJKL0123") == [("assign", "base64/")]
    whole = zlib.compress(b"so many words " * 9 + b"token = abcdefGHIJKL0123 " + bytes(range(65, 91)) * 9 + random.Random(1).randbytes(90).hex().encode())
    assert assigned(whole[:-20]) == [("assign", "base64/compressed/")]
    assert assigned(gzip.compress(zlib.compress(bz2.compress(b"token = abcdefGHIJKL0123")))) == [("assign", "base64/" + 3 * "compressed/")]


@pytest.mark.parametrize("sign, step, last", [("%", "25", "41"), ("\\", "u005c", "u0041"), ("\\", "x5c", "x41"), ("&", "#38;", "#65;"), ("&", "#x26;", "#x41;")])
def test_deep_escapes(sign, step, last):
    for depth in (1, 3, 7, 8, 9, 20, 1001):
        text = f"so {sign}{step * depth}{last}KIAABCDEFGHIJKLMN on"
        got = [(s["kind"], text[s["start"] : s["end"]]) for s in secrets.spans_of(text) if s["kind"] == "access"]
        assert got == [("access", text[3:-3])], depth
    begin = time.monotonic()
    secrets.spans_of(sign + step * (1_000_000 // len(step)) + last)
    assert time.monotonic() - begin < 20


def test_levels_stay_apart():
    """Base64 that can be decoded one level down, and neither before nor after."""
    inner = base64.b64encode(b"xx password = abcdefGHIJKL0123 words").decode()
    assert inner[0] == "e" and len(inner) % 4 == 0 and "=" not in inner
    spans = secrets.spans_of(f"a %65{inner[1:]}%252F b")
    assert [(s["kind"], s["way"]) for s in spans] == [("assign", "url/base64/")]


def test_item_with_an_empty_id(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "doc_id long, text string")
    items = spark.createDataFrame([("", "two three"), (None, "five"), ("=x", "four")], "item_id string, text string")
    got = {r["doc_id"]: sorted(r["items"]) for r in decontaminate.find(docs, items).collect()}
    assert got == {1: ["", "=x"], 2: []}
