"""PII and secrets: fixed patterns against plain regular expressions, and what the methods add."""

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from meguri.llm import pii, secrets
from meguri.llm.boosting import Calibrated, Trees
from meguri.llm.common import table
from meguri.llm.spans import redacted

FOLDER = "/root/testdata/sf0.001"


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(text):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_pii_on_random_texts():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "_", "%", " ", "1", "22", "255", "256", "007", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_base_secrets_on_random_texts():
    rng = random.Random(2)
    parts = ["Token", "ſecret", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefghijklm", "0123456789abcdef0", "AKIA", "ABCDEFGHIJKLMNOP", ".", "passwd", "K"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.scan(text) == plain_secrets(text), text


def test_scans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b@" * 60_000, "+1 " + "(" * 200_000, "token" * 50_000, "%41" * 50_000, "A" * 300_000):
        pii.base_spans(text)
        pii.proposals(text)
        secrets.spans_of(text)


def model_of(texts):
    x, y, kind, owner = pii.examples(texts)
    return Calibrated(Trees()).fit(x, y, kind, owner % 3 == 2), (x, y, kind, owner)


def samples(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        card = next(c for c in (d(16) for _ in iter(int, 1)) if pii.luhn(c))
        span = [f"{word()}.{d(2)}@{word()}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, f"+1 ({d(3)}) 555-{d(4)}", d(rng.randint(2, 11))][i % 5]
        out.append(" ".join([*(word() for _ in range(20)), span, *(word() for _ in range(20))]))
    return out


def test_added_spans_and_held_out_accuracy():
    model, _ = model_of(samples())
    x, y, _, _ = pii.examples(samples(seed=99), seed=5)
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.95
    text = "some words then bob.smith at mail dot example dot com and more words"
    added = [s for s in pii.spans_of(text, model) if not s["base"]]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in added] == [("email", "bob.smith at mail dot example dot com")]
    for clean in ("we look at this. Then we go.", "it is 2020 and 12 more", "", "on 2020-10-11 at 12:30"):
        assert pii.spans_of(clean, model) == []


def test_model_without_examples_adds_nothing():
    model = Calibrated(Trees())
    assert model.fit(np.zeros((0, 26)), np.zeros(0), np.zeros(0, dtype=str), np.zeros(0, dtype=bool)).cut == {}
    assert pii.spans_of("bob at mail dot com", model) == []


SECRET = 'api_key = "abcdefGHIJKL0123"'


@pytest.mark.parametrize("wrapped, way", [
    (urllib.parse.quote(SECRET), "url/"),
    (urllib.parse.quote(urllib.parse.quote(SECRET)), "url/url/"),
    ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode/"),
    ("".join(f"&#x{ord(c):x};" for c in SECRET), "unicode/"),
    (base64.b64encode(SECRET.encode()).decode(), "base64/"),
    (base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode(), "base64/compressed/"),
    (base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(), "base64/compressed/base64/"),
])
def test_layers(wrapped, way):
    text = f"é intro {wrapped} outro"
    found = secrets.spans_of(text)
    mine = [s for s in found if not s["base"] and s["kind"] == "assign"]
    assert [s["way"] for s in mine] == [way]
    inside = text[mine[0]["start"] : mine[0]["end"]]
    assert inside in wrapped and len(inside) >= len(wrapped) - 9


def test_layers_end():
    spans = secrets.spans_of(base64.b64encode(zlib.compress(b"token=" + b"z" * 50_000_000)).decode())
    assert [s["kind"] for s in spans] == ["assign"]
    assert secrets.spans_of("%25" * 2000) == []  # each round takes one sign off


def test_redacted():
    assert redacted("call +1 now", [("phone", 5, 7)]) == "call [phone] now"
    assert redacted("abcdef", [("a", 0, 3), ("b", 2, 5)]) == "[a]f"


def rows(spark, extra=True):
    return spark.createDataFrame(
        [(1, "mail a@b.co", "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.co " * 3000, "x"), (1, "mail a@b.co", "x"), (4, "token = \"abcdefghijkl\" %41KIAABCDEFGHIJKLMN", "x")],
        "doc_id long, text string, spans string",
    )


def test_odd_rows(spark):
    model, _ = model_of(samples(60))
    got = sorted(((r["doc_id"], len(r["spans"])) for r in pii.find(rows(spark), model).collect()), key=str)
    assert got == sorted([(1, 1), (2, 0), (3, 0), (None, 3000), (1, 1), (4, 0)], key=str)
    kinds = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in secrets.find(rows(spark)).collect()}
    assert kinds[4] == [("assign", True), ("access", False)]
    assert pii.find(rows(spark).limit(0), model).count() == 0
    assert {r["text"] for r in pii.redact(rows(spark).filter("doc_id < 4"), model).collect()} == {"mail [email]", None, ""}
    assert secrets.redact(rows(spark).filter("doc_id = 4")).first()["text"] == "[assign]\" [access]"


def test_queries_against_plain(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    for query, plain, kinds in ((pii.op3, plain_pii, pii.KINDS), (secrets.op6, plain_secrets, secrets.KINDS)):
        got = query(spark, FOLDER).collect()
        assert len(got) == len(docs)
        for r in got:
            base = plain(docs[r["doc_id"]])
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == k for b in base) for k in kinds]
            assert set(text.split(",")) <= set(r["spans"].split(","))
