"""Signatures of lines look at every shingle, not only at those where words begin."""

from __future__ import annotations

import random

from meguri.llm import line_dedup

PAIRS = 60


def _line(rng: random.Random) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = " ".join(rng.choice(letters) for _ in range(10))
    return short + " " + " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(17))


def test_changes_among_short_words_do_not_hide_a_line(spark, tmp_path):
    """Two changed letters cost 18 of about 180 shingles, but nine of the 27 at word beginnings."""
    rng = random.Random(3)
    texts = []
    for _ in range(PAIRS):
        line = _line(rng)
        texts += [line, line[:8] + "1" + line[9:16] + "2" + line[17:]]
    rows = [(i, text) for i, text in enumerate(texts)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    bands = {r["id"]: set(r["bands"]) for r in line_dedup.signatures(spark.read.parquet(path)).collect()}
    ids = {r["text"]: r["id"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) AS id").collect()}
    met = sum(bool(bands[ids[texts[2 * k]]] & bands[ids[texts[2 * k + 1]]]) for k in range(PAIRS))
    assert met >= 0.93 * PAIRS


def test_every_shingle_counts(spark):
    docs = spark.createDataFrame([(1, "abcdefghij klm"), (2, "short"), (3, "")], "doc_id long, text string")
    for text, n in (("abcdefghij klm", 6), ("short", 1)):
        rows = line_dedup._hashed(docs.filter(docs.text == text).selectExpr("doc_id AS id", "text"), "text")
        assert rows.count() == n


def test_shingles_have_the_hash_of_their_text(spark):
    """Whether a stretch is cut as bytes or as characters; lines mix both, and only single bytes are cut as bytes."""
    rng = random.Random(5)
    texts = ["short", "日本", "é", "abcdefgh", "abcdefghi", "日本語" * 30, "\0a\x7f" * 9, "x" * 200]
    texts += ["".join(rng.choice("ab cé日😀" if k % 2 else "abcde fg") for _ in range(rng.randrange(1, 150))) for k in range(40)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    shingles = [(i, t[k : k + 9]) for i, t in enumerate(texts) for k in range(max(1, len(t) - 8))]
    want = sorted(tuple(r) for r in spark.createDataFrame(shingles, "id long, s string").selectExpr("id", "xxhash64(s)").collect())
    hashed = line_dedup._hashed(lines, "text")
    assert sorted(tuple(r) for r in hashed.collect()) == want
    assert "as binary" in hashed._jdf.queryExecution().optimizedPlan().toString()
