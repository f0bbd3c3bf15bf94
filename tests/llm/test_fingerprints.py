"""Fingerprints against sums of single paragraphs, and likeness against counted word runs."""

import hashlib
import random
from collections import Counter

import numpy as np
from meguri.llm import fingerprints as fp
from meguri.llm.common import step, table

FOLDER = "/root/testdata/sf0.001"


def plain_edits(rows):
    """(text, edited text, next text) of each (doc_id, text), by a sort of them all."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    out = [None] * len(rows)
    for k, i in enumerate(order):
        text, following = (rows[j][1] or "" for j in (i, order[(k + 1) % len(order)]))
        n = len(text) // 4
        out[i] = text, text[: len(text) - n] + following[:n], following
    return out


def plain_likeness(a, b):
    def runs(text):
        words = [p.split() for p in text.encode().split(b"\n")]
        return Counter(tuple(w[i : i + 3]) for w in words if w for i in range(max(1, len(w) - 2)))
    x, y = runs(a), runs(b)
    if a == b:
        return 1.0
    both = sum(n * n for n in (*x.values(), *y.values()))
    return 2 * sum(n * y[k] for k, n in x.items()) / both if both else 0.0


def check(rows, got):
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), *fp.summed([fp.paragraphs(t), fp.paragraphs(e)]).written()) for (i, *_), (t, e, _) in zip(rows, plain_edits(rows))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def columns(df):
    return [tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) for r in df.collect()]


def test_odd_rows(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "abc", "abcd", "\n\n\n", "\n".join("xyz"), "日本😀\r\nü ß\x00 ", "one line only " * 30, " " * 9]
    texts += ["".join(rng.choice("ab \né😀") for _ in range(rng.randrange(200))) for _ in range(80)]
    texts += ["long words here " * 40_000, "same\ntext", "same\ntext"]
    rows = [(rng.choice([None, *range(60)]), t) for t in texts]
    docs = step(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, copy int").coalesce(1))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, columns(fp.edited(docs)))
    assert fp.edited(docs.limit(0)).count() == 0
    one = step(spark.createDataFrame([(5, "abcdefgh")], "doc_id int, text string"))
    got = fp.edited(one).first()
    assert got["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and got["near_next"] == 1


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    check(rows, columns(fp.op13(spark, FOLDER)))
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in fp.op13(spark, FOLDER).collect()}
    errors = []
    for (i, _), (text, new, following) in zip(rows, plain_edits(rows)):
        for got, other in zip(near[i], (new, following)):
            assert 0 <= got <= 1
            errors.append(got - plain_likeness(text, other))
    assert np.sqrt(np.mean(np.square(errors))) < 0.07 and abs(np.mean(errors)) < 0.03
    assert {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(table(spark, FOLDER, "documents")).collect()} == {
        i: x for (i, t) in rows for x in fp.summed([fp.paragraphs(t or "")]).written()}


def test_order_and_increments():
    rng = random.Random(1)
    parts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    mixed = parts[:]
    rng.shuffle(mixed)
    whole = fp.summed([parts])
    assert whole.written() == fp.summed([mixed]).written() == fp.read(whole.written()).written()
    assert whole.written() != fp.summed([parts + parts[:1]]).written()  # a multiset, not a set
    assert fp.changed(fp.summed([parts[:30]]), [parts[:5]], [parts[30:]]).written() == fp.summed([parts[5:]]).written()
    single = fp.summed([[p] for p in parts])
    added = fp.Sums(single.exact[:1], single.alike[:1])
    for k in range(1, len(parts)):
        added = added + single[k : k + 1]
    assert added.written() == whole.written()
    assert len({w for w in fp.summed([[p] for p in {*parts}]).written()}) == len({*parts})
