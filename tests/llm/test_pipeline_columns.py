"""Stages of the pipeline hand on extra columns whose names the operators use themselves."""

import corpus_pipeline
from meguri.llm import decontaminate, toxicity
from meguri.llm.common import step, table
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["spans", "items", "n_words", "severity", "grade", "rejected", "p_1", "contaminated", "_row", "_gone", "row", "component"]


def test_clashing_columns(spark):
    docs = table(spark, FOLDER, "documents")
    more = step(docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in EXTRA]))
    for stage in (corpus_pipeline.without_toxic, corpus_pipeline.without_benchmark):
        plain = {r["doc_id"] for r in stage(spark, docs, FOLDER).collect()}
        got = stage(spark, more, FOLDER)
        assert got.columns == more.columns
        rows = got.collect()
        assert {r["doc_id"] for r in rows} == plain
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in EXTRA)


def test_operators_carry_clashing_columns(spark):
    names = ["spans", "doc_spans", "Items", "n_words", "n_hit", "contaminated", "severity", "grade", "P_1", "rejected", "_text", "_carried_0", "a.b"]
    docs = step(table(spark, FOLDER, "documents").select("doc_id", "text", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in names]))
    items, carry = table(spark, FOLDER, "benchmark"), (*names, "text", "doc_id")
    plain = {r["doc_id"]: tuple(r) for r in decontaminate.with_verdict(decontaminate.find(docs, items)).collect()}
    for size in (8 << 20, 1 << 14):  # one pass over the rows, and several
        found = decontaminate.with_verdict(decontaminate.find(docs, items, block_bytes=size, carry=carry))
        at = found.columns
        assert at == ["doc_id", "doc_spans", "doc_doc_spans", "doc_Items", "doc_n_words", "doc_n_hit", "doc_contaminated", *names[6:], "text", "doc_doc_id", "n_words", "spans", "items", "n_hit", "contaminated"]
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(plain)
        for r in rows:
            assert r[1:14] == tuple(f"{c}:{r[0]}" for c in names) and r[15] == r[0]
            assert (r[0], r[16], sorted(r[17]), sorted(r[18]), *r[19:]) == (r[0], plain[r[0]][1], sorted(plain[r[0]][2]), sorted(plain[r[0]][3]), *plain[r[0]][4:])
    model = toxicity.fit(docs, table(spark, FOLDER, "labels"))
    marks = {r["doc_id"]: tuple(r)[1:] for r in toxicity.score(docs, model).collect()}
    scored = toxicity.score(docs, model, carry)
    assert len(set(map(str.lower, scored.columns))) == len(scored.columns)
    for r in map(tuple, scored.collect()):
        assert r[1:14] == tuple(f"{c}:{r[0]}" for c in names) and r[16:] == marks[r[0]]
    assert toxicity.score(docs.limit(0), model, carry).count() == decontaminate.find(docs.limit(0), items, carry=carry).count() == 0
