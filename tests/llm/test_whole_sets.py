"""Whole sets and every linked pair in line dedup and the n-gram join, whole payloads in secrets."""

import base64
import gzip
import random
import textwrap

import numpy as np
import pytest
import test_groups
from meguri.llm import line_dedup, ngram_join, secrets
from meguri.llm.common import step
from pyspark.sql import functions as F
from meguri.llm.components import all_bucket_links


def test_lines_hold_all_their_shingles(spark):
    rng = random.Random(4)
    lines = ["a", "é" * 30, "日本語のとても長い一行です、はい", "日本", "abcdefghij abcdefghij", "x" * 9, "😀" * 12, "a\rb" * 40]
    lines += ["".join(rng.choice("abé日 ,😀") for _ in range(n)).strip() or "a" for n in (8, 9, 10, 31, 32, 33, 39, 40, 41, 42, 64, 72, 73, 500)]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    said = line_dedup._said(docs)
    got = {r["said"]: r["n"] for r in line_dedup.lines_of(docs, said.select("id")).select(F.col("line").alias("said"), F.size(F.array_distinct(line_dedup._shingles(F.col("line")))).alias("n")).collect()}
    assert got == {x: len(test_groups.line_set(x)) for x in lines}


def test_lines_without_blanks_stay_apart(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    lines = [f"https://example.com/{text(40)}" for _ in range(20)] + [f"2024-01-01\t{text(30)}\t{text(30)}" for _ in range(20)]
    lines += ["Andththwhes.", "Andththwhwh."]
    long = text(200)  # one blank-free line and the same with another end
    lines += [long, long + "x"]
    docs = step(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").coalesce(1))
    goes = {r["doc_id"] for r in line_dedup.dropped(docs).filter("goes").collect()}
    assert goes == {len(lines) - 1}


def test_many_groups_in_one_bucket(spark):
    rng, sets = random.Random(9), {}
    for g in range(40):  # forty groups of four, none of them joined with another
        base = [1000 * g + k for k in range(20)]
        for _ in range(4):
            sets[len(sets)] = {*base, *range(-5, 0), rng.randrange(10**6, 10**9)}
    order = list(sets)
    rng.shuffle(order)
    sets = {i: sets[k] for i, k in enumerate(order)}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(7, i) for i in sets], "bucket long, id long")
    held = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item long")
    linked = lambda pairs: pairs.join(spark.createDataFrame(sorted(near), "a long, b long"), ["a", "b"])
    got, want = test_groups.Union(), test_groups.Union()
    for a, b in near:
        want.join(a, b)
    for r in all_bucket_links(members, lambda ids: held.join(ids, "id"), linked, (80, 100)).collect():
        assert (r["a"], r["b"]) in near
        got.join(r["a"], r["b"])
    assert all(got.find(i) == want.find(i) for i in sets) and len(near) == 240


def test_crowded_template_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BANDS", 1)  # lines meet in one bucket or nowhere
    monkeypatch.setattr(line_dedup, "ROWS", 1)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    head, lines = text(200), []
    for _ in range(60):
        own = text(40)
        lines += [f"{head}{own}{text(3)}" for _ in range(3)]
    rng.shuffle(lines)
    docs = step(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1))
    names = {r["said"]: r["id"] for r in line_dedup._said(docs).collect()}
    by = {}
    for r in line_dedup.signatures(docs).collect():
        by.setdefault(r["bands"][0], set()).add(r["id"])
    got = test_groups.Union()
    for r in line_dedup.links(docs).collect():
        got.join(r["a"], r["b"])
    assert max(map(len, by.values())) > 32
    for bucket in by.values():
        mine = [x for x in lines if names[x] in bucket]
        for x in mine:
            for y in mine:
                if 100 * len(test_groups.line_set(x) & test_groups.line_set(y)) >= 80 * len(test_groups.line_set(x) | test_groups.line_set(y)):
                    assert got.find(names[x]) == got.find(names[y])


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("frame", ["{}", "-----BEGIN X-----\n{}\n-----END X-----", "see\n\n{}\n\nthere", "data: {}\nword\nmore words"])
@pytest.mark.parametrize("packed, brk", [(False, "\n"), (False, "\r\n"), (False, "\n    "), (True, "\n")])
def test_wrapped_base64(width, frame, packed, brk):
    rng = random.Random(width)
    for n in range(40, 58):  # the secret lies over the break, and last lines are of any length
        said = f"{'é' * 5}{'x' * (n - 10)} api_key = abcdefGHIJKL0123 {rng.getrandbits(400):x}"
        data = gzip.compress(said.encode()) if packed else said.encode()
        text = frame.format(brk.join(textwrap.wrap(base64.b64encode(data).decode(), width)))
        spans = secrets.spans_of(text)
        mine = [s for s in spans if s["kind"] == "assign" and not s["base"]]
        assert any("\n" in text[s["start"] : s["end"]] and s["way"] == ("base64/compressed/" if packed else "base64/") for s in mine)


def test_small_sets_without_a_shared_signature(spark):
    rng = random.Random(21)
    shorter = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(8)) for _ in range(6000)]
    texts = [t for x in shorter for t in (x, f"{x} more")]
    of, sigs = ngram_join.signatures(*ngram_join.shingle_sets(texts), ngram_join.Bands())
    order = np.argsort(of, kind="stable")
    by = [set(s.tolist()) for s in np.split(sigs[order], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])]
    apart = [i for i in range(0, len(texts), 2) if not by[i] & by[i + 1]]
    assert apart
    rows = {j: texts[j] for i in [*apart, *range(0, 40, 2)] for j in (i, i + 1)}
    docs = step(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == test_groups.plain_join(rows)
