"""Repetition, decontamination and toxicity against plain versions."""

import hashlib
import random
import re

import numpy as np

from meguri.llm import decontaminate, quality, toxicity
from meguri.llm.common import table
from meguri.llm.fmindex import FMIndex
from meguri.llm.suffixes import longest_repeats

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain_quality(text, least=8):
    w = WORD.findall(text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    five, spans, seen, dup = set(), set(), set(), 0
    for i, k in enumerate(longest):
        five |= set(range(i, i + 5)) if k >= 5 else set()
        spans |= set(range(i, i + k)) if k >= least else set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    best = max([k for k in longest if k >= least], default=0)
    failed = n < 10 or 100 * len(five) > 20 * n
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
        "n_repeat_words": len(five), "base_failed": failed, "kept": not failed and len(spans) <= 0.2 * n and best <= 100,
        "covered_words": len(spans), "longest_repeat": best,
    }, spans


def test_quality_on_random_texts():
    rng = random.Random(3)
    for _ in range(120):
        texts = ["".join(rng.choice(["a ", "b ", "c ", "a b c a d ", "é ", "\n", "#x ", " ", "\t"]) for _ in range(rng.choice([0, 1, 5, 30, 80]))) for _ in range(rng.randint(0, 6))]
        got = quality.judged(texts, 8, 0.2, 100)
        for i, text in enumerate(texts):
            want, spans = plain_quality(text)
            assert {k: got[k][i] for k in want} == want, text
            assert {x for s in got["repeats"][i] for x in range(s["start"], s["end"])} == spans


def test_quality_limits():
    once = [f"w{i}" for i in range(2000)]
    again = " ".join([*once, *once[:150], *once[5:6]])
    got = quality.judged([" ".join(once), again, "a " * 30_000], 8, 0.2, 100)
    assert list(got["kept"]) == [True, False, False] and list(got["longest_repeat"]) == [0, 150, 29_999]
    assert list(got["base_failed"]) == [False, False, True]


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b c d e f g h i j", 5), (2, "", 5)], "doc_id long, text string, kept int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality.judge(docs).collect())
    assert got == [(0, 10, True), (1, 0, False), (2, 0, False), (2, 0, False)]
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    got = {r["doc_id"]: r for r in quality.op8(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        if len(text) < 4000:
            want, _ = plain_quality(text)
            assert {k: got[i][k] for k in want} == want


def test_longest_repeats_of_equal_texts():
    codes = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2], dtype=np.int64)
    assert longest_repeats(np.array([0, 3, 9]), codes, 1).tolist() == [0, 0, 0, 3, 2, 1, 3, 2, 1]


# -- decontamination ----------------------------------------------------------
def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = rng.integers(1, 5, size=rng.integers(1, 80))
        index = FMIndex(text, 5, sample=int(rng.integers(1, 9)))
        for length in (1, 2, 3):
            patterns = rng.integers(1, 5, size=(20, length))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def plain_hits(texts, items, width):
    windows = {}
    for name, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(name)
    lengths, out = {len(k) for k in windows}, []
    for text in texts:
        w, hit, names = ALNUM.findall(lower(text)), set(), set()
        for i in range(len(w)):
            for n in lengths:
                key = tuple(w[i : i + n])
                if len(key) == n and key in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[key]
        out.append((len(w), hit, names))
    return out


def test_windows_on_random_texts():
    rng = random.Random(5)
    for _ in range(200):
        make = lambda n: "".join(rng.choice(["a ", "B ", "c-", "é1 ", "zz ", "dd ", "É ", "_"]) for _ in range(rng.randint(0, n)))
        texts, items = [make(60) for _ in range(rng.randint(0, 8))], [(str(i), make(9)) for i in range(rng.randint(0, 5))]
        shard = decontaminate.Shard(decontaminate.Windows(items, 3))
        shard.add(texts[:3])
        shard.add(texts[3:])
        spans, names = shard.found()
        for i, (n, hit, want) in enumerate(plain_hits(texts, items, 3)):
            assert shard.counts[i] == n and names[i] == want
            assert {x for a, b in spans[i] for x in range(a, b)} == hit


def test_decontaminate_rows_and_blocks(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = ["x " * 30 + item + " y" * 30, item.upper().replace(" ", ", "), "clean words only", None, "", "short test", "x " * 400 + " ".join(item.split()[:13])]
    docs = spark.createDataFrame([(i if i else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, item, 1), (12, "Short-test", 1), (None, "q0 q1 q2", 1), (9, None, 1), (10, "", 1), (7, item, 1)], "item_id long, text string, spans int")
    for block, shard in ((8 << 20, 2_000_000), (30, 4)):
        got = {r["doc_id"]: r for r in decontaminate.with_verdict(decontaminate.find(docs, bench, block_bytes=block, shard_words=shard)).collect()}
        want = plain_hits([t or "" for t in texts], [("7", item), ("12", "Short-test"), ("", "q0 q1 q2")], 13)
        for i, (n, hit, names) in enumerate(want):
            r = got[i if i else None]
            assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, len(hit), names - {""})
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)
            assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert all(not r["spans"] for r in decontaminate.find(docs, bench.limit(0)).collect())


def test_decontaminate_query(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, FOLDER, "documents").collect()]
    items = [(str(r["item_id"]), r["text"] or "") for r in table(spark, FOLDER, "benchmark").collect()]
    got = {r["doc_id"]: r for r in decontaminate.op5(spark, FOLDER).collect()}
    for (i, _), (n, hit, names) in zip(docs, plain_hits([t for _, t in docs], items, 13)):
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, len(hit), len(names), sha)


# -- toxicity -----------------------------------------------------------------
def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    n, width = 200, 30
    text, word = np.repeat(np.arange(n), 5), rng.integers(0, width, n * 5)
    signal = np.bincount(text, word < 5, n)
    grade = np.minimum(signal, 2).astype(np.int64)
    model = toxicity.Ordinal(3, least_ratio=0, least_texts=1, rounds=400).fit(text, word, np.ones(n * 5), grade)
    p = model.chances(text, word, np.ones(n * 5), n)
    assert (np.diff(model.thresholds) > 0).all() and (p[:, 0] >= p[:, 1]).all()
    assert ((p >= 0.5).sum(axis=1) == grade).mean() > 0.9


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 0"))
    held = labels.filter("doc_id % 4 = 0").select("doc_id", "toxic")
    got = toxicity.score(docs, model).join(held, "doc_id").select("rejected", "toxic", "severity").toPandas()
    assert (got.rejected == (got.toxic > 0)).mean() > 0.95
    assert (got.toxic[got.rejected] > 0).mean() > 0.95 and got.rejected[got.toxic > 0].mean() > 0.7
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "trash idiot moron scum loser " * 9, 1.0), (2, "", 1.0)], "doc_id long, text string, severity double")
    rows = sorted((r["doc_id"] or 0, r["rejected"], r["grade"]) for r in toxicity.score(odd, model).collect())
    assert [x[:2] for x in rows] == [(0, True), (1, False), (2, False), (2, False)]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "trash", 1)], "doc_id long, text string, toxic int")
    for labels in ([], [(1, None)], [(None, 1)], [(1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not toxicity.score(docs, model).first()["rejected"]
