"""Quotations, line dedup, the n-gram join, components and the pipeline against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from meguri.llm import decontaminate, line_dedup, ngram_join, quotations
from pyspark.sql import functions as F
from meguri.llm.common import step, table
from meguri.llm.components import bucket_links, components

FOLDER = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    for edges in ([], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)], [(rng.randint(-99, 99), rng.randint(-99, 99)) for _ in range(120)], [(5, 5), (1, 2)]):
        want = Union()
        for a, b in edges:
            if a != b:
                want.join(a, b)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: want.find(x) for x in want.up}


def test_bucket_links_are_links_and_join_clear_groups(spark):
    rng = random.Random(2)
    values = {i: rng.choice([0, 100, 200]) + rng.randint(0, 2) for i in range(120)}  # three groups, all linked within
    members = spark.createDataFrame([(i % 3, i) for i in values] + [(9, i) for i in list(values)[:40]], "bucket long, id long")
    near = {(a, b) for a in values for b in values if a < b and abs(values[a] - values[b]) <= 2}
    linked = lambda pairs: pairs.join(spark.createDataFrame(sorted(near), "a long, b long"), ["a", "b"])
    got = Union()
    for r in bucket_links(members, linked, 2).collect():
        assert (r["a"], r["b"]) in near
        got.join(r["a"], r["b"])
    for bucket in range(3):
        for low in (0, 100, 200):
            assert len({got.find(i) for i in values if i % 3 == bucket and values[i] // 100 * 100 == low}) == 1


# -- n-gram join --------------------------------------------------------------
def plain_set(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_join(texts):
    """(set size, smallest linked id) by comparing all pairs; texts by id."""
    sets, group = {i: plain_set(t) for i, t in texts.items()}, Union()
    ids = sorted(texts)
    for n, i in enumerate(ids):
        group.find(i)
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                group.join(i, j)
    return {i: (len(sets[i]), group.find(i)) for i in ids}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        if words:
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words[: len(words) - rng.randint(0, 2)])


def corpus(seed, n, per):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(n):
        base = " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200])))
        base = f"{base} {passage}" if rng.random() < 0.3 else base
        texts += [varied(rng, base, rng.randint(0, max(1, len(base.split()) // 40))) for _ in range(rng.randint(1, per))]
    return texts


def test_sets_and_keys():
    rng = random.Random(3)
    texts = ["", "a", "A", "a b", "a b c d e", "x\x0by é z", "　 a", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    starts, values = ngram_join.shingle_sets(texts)
    sets = [plain_set(t) for t in texts]
    assert np.diff(starts).tolist() == list(map(len, sets))
    keys = {}
    for s, k in zip(sets, ngram_join.set_keys(starts, values).tolist()):
        assert keys.setdefault(frozenset(s), k) == k and (k == 0) == (not s)
    assert len(set(keys.values())) == len(keys)


def test_signatures_lose_no_link():
    texts = corpus(5, 150, 6)
    starts, values = ngram_join.shingle_sets(texts)
    bands, sets = ngram_join.Bands(), [plain_set(t) for t in texts]
    of, sigs = ngram_join.signatures(starts, values, bands)
    spare, below = ngram_join.spares(starts, values, bands)
    by, links = defaultdict(set), 0
    for o, s in zip(of.tolist(), sigs.tolist()):
        by[o].add(s)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a != b and 100 * len(a & b) >= 80 * len(a | b):
                links += 1
                band = int(min(bands.band(np.array([len(a), len(b)]))))
                same = sum((s & 255) == band for s in by[i] & by[j])
                for k, size in ((i, len(a)), (j, len(b))):
                    left = spare[k] if bands.band(np.array([size]))[0] == band else below[k]
                    assert same >= left + 1
    assert links > 100


def test_join_against_all_pairs(spark, monkeypatch):
    for crowd, seed in ((32, 7), (2, 8)):
        monkeypatch.setattr(ngram_join, "CROWD", crowd)
        texts = dict(enumerate(corpus(seed, 60, 8)))
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(step(docs)).collect()}
        assert got == plain_join(texts)


def test_join_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, "a b c d e f"), (None, "A b c d e f"), (6, "a b c d e f"), (None, None), (7, "z " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int").coalesce(1)
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (0, 2, 6), (6, 2, 6), (0, 0, None), (7, 1, 7)]
    assert got == sorted(want, key=str)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_join_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op7(spark, FOLDER).collect()} == plain_join(docs)


# -- lines --------------------------------------------------------------------
def line_set(line):
    k = line_dedup.SHINGLE
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def plain_lines(texts):
    """Component of each distinct line, by comparing all pairs."""
    lines, group = [], Union()
    for t in texts:
        lines += [x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")]
    lines = sorted({x for x in lines if x})
    sets = [line_set(x) for x in lines]
    for i, a in enumerate(sets):
        group.find(lines[i])
        for j, b in enumerate(sets[:i]):
            if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                group.join(lines[i], lines[j])
    return {x: group.find(x) for x in lines}


def line_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorstlé") for _ in range(rng.randint(1, 9)))
    bases = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 30, 60]))) for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(bases).split()
            if rng.random() < 0.4 and len(words) > 10:
                words[rng.randrange(len(words))] = word()
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words))
        texts.append("\n".join(lines))
    return texts


def test_shingles_of_lines(spark):
    lines = ["a", "é" * 30, "日本語のとても長い一行です、はい", "日本", "abcdefghij abcdefghij", "x" * 9, "😀" * 12, "\tthe end  of the end of\r"]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    said = line_dedup._said(docs)
    got = {r["said"]: r["n"] for r in line_dedup.lines_of(docs, said.select("id")).select(F.col("line").alias("said"), F.size(F.array_distinct(line_dedup._shingles(F.col("line")))).alias("n")).collect()}
    assert got == {x.strip(): len(line_set(x.strip())) for x in lines}


def test_lines_against_all_pairs(spark):
    texts = line_corpus(11)
    docs = step(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2))
    want = plain_lines(texts)
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                at[i, k] = want[line.strip(" \t\r\x0b\x0c")]
    got = {(r["doc_id"], r["line"]): (r["component"], r["goes"]) for r in line_dedup.dropped(docs).collect()}
    assert set(got) == set(at)
    names = {}
    for key, (component, _) in got.items():  # nothing joined that isn't a near duplicate, at least 0.97 of those found
        assert names.setdefault(component, at[key]) == at[key]
    assert len(names) <= len(set(at.values())) + max(1, 0.03 * len(at))
    first = {}
    for key in sorted(got):
        assert got[key][1] == (got[key][0] in first)
        first.setdefault(got[key][0], key)


def test_deduplicated(spark):
    rows = [(1, "one line here\n\nanother line", "x", 3), (2, "another line", "x", 3), (3, None, "x", 3), (4, "", "x", 3), (5, " \n", "x", 3), (6, "one line here \nnew one", "x", 3), (None, "another line\nmy own", "x", 3), (8, "many " * 30_000, "x", 3), (8, "many " * 30_000, "x", 3)]
    docs = step(spark.createDataFrame(rows, "doc_id long, text string, line string, id int").coalesce(1))
    got = [(r["doc_id"], r["text"]) for r in line_dedup.deduplicated(docs).collect()]
    want = [(1, "one line here\n"), (3, None), (4, ""), (5, " \n"), (6, "new one"), (None, "another line\nmy own"), (8, "many " * 30_000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_line_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    want, seen = plain_lines(docs.values()), set()
    gone = {}
    for i in sorted(docs):
        gone[i] = []
        for k, line in enumerate(docs[i].split("\n")):
            name = want.get(line.strip(" \t\r\x0b\x0c"))
            if name is not None and name in seen:
                gone[i].append(str(k))
            seen.add(name)
    got = line_dedup.op9(spark, FOLDER).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in got} == {i: ",".join(g) for i, g in gone.items()}
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: len(g) for i, g in gone.items()}


# -- quotations ---------------------------------------------------------------
THREAD = [
    (1, 0, "user", "Shall we meet on Monday?\nI could do ten o'clock.\n\nAlso bring the plans."),
    (1, 1, "assistant", "On Monday, Ann wrote:\n> Shall we meet on Monday?\n> I could do ten o'clock.\n\nTen is fine."),
    (1, 2, "user", "An aside."),
    (1, 3, "user", "Bob wrote:\n> On Monday, Ann wrote:\n>> also bring the PLANS\n> Ten is fine.\n\nThen it is settled."),
    (1, 4, "assistant", ">> Also bring the plans.\nI shall."),
    (1, 5, "user", "> nobody said this\nWho did?"),
    (2, 0, "user", "> Ten is fine.\nanother conversation"),
]


def test_thread(spark):
    got = {(r["conv_id"], r["turn"]): r for r in quotations.reply_ordered(spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 1, (1, 4): 0, (1, 5): None, (2, 0): None}
    assert {k: (r["thread"], r["depth"]) for k, r in got.items() if k[0] == 1} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (2, 0), (1, 3): (0, 2), (1, 4): (0, 1), (1, 5): (5, 0)}
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])] == [0, 1, 3, 4, 2, 5]
    assert got[1, 1]["text"] == "Ten is fine." and got[1, 3]["text"] == "Then it is settled." and got[1, 0]["text"] == THREAD[0][3]
    assert (got[1, 3]["n_quotes"], got[1, 3]["n_linked"]) == (2, 2)


def test_parsing():
    assert quotations.parsed("no quotes\n\n\nat all ") == ("no quotes\n\n\nat all ", [])
    text, quotes = quotations.parsed("> a\n> > b\n> a2\nmine\n>>>c")
    assert text == "mine" and [(q["level"], q["first_line"], q["last_line"]) for q in quotes] == [(1, 0, 0), (2, 1, 1), (1, 2, 2), (3, 4, 4)]
    assert quotations.units("A  b.\nc") == quotations.units("a b.\nC!") and len(quotations.units("a\n\nb")) == 3
    assert quotations.parsed("> \n>\n") == ("", [])


def test_long_chain_and_hot_passage(spark):
    n = 300
    chain = [(1, i, "user", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(n)]
    star = [(2, i, "user", "> the very first\nthe same answer" if i else "the very first") for i in range(n)]
    got = {(r["conv_id"], r["turn"]): r for r in quotations.reply_ordered(spark.createDataFrame(chain + star, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert all((got[1, i]["depth"], got[1, i]["thread"], got[1, i]["position"]) == (i, 0, i) for i in range(n))
    assert all((got[2, i]["depth"], got[2, i]["reply_to"], got[2, i]["position"]) == (min(i, 1), 0 if i else None, i) for i in range(n))


def test_quotation_odd_rows(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "user", "> hi\nyes"), (1, None, "user", "> hi"), (1, 0, None, None), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "user", "> same"), (3, 0, "user", ""), (4, 0, "user", "> " * 20_000)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = quotations.formatted(quotations.reply_ordered(frame)).collect()
    assert len(got) == len(rows)
    assert sorted((r["conv_id"] or 0, r["position"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0)]
    assert {r["reply_to"] for r in got if r["conv_id"] == 2} == {None, 0} and all(r["reply_to"] is None for r in got if r["conv_id"] != 2)
    assert quotations.reply_ordered(frame.limit(0)).count() == 0


def test_quotation_query(spark):
    want = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, FOLDER, "conversations").collect()}
    got = quotations.op1(spark, FOLDER).collect()
    assert {(r["conv_id"], r["turn"]): quotations.parsed(r["text"])[0] for r in got} == {k: quotations.parsed(t)[0] for k, t in want.items()}


# -- pipeline -----------------------------------------------------------------
def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    planted = spark.createDataFrame([
        (900_001, "nobody has ever written these words " + " ".join(f"p{i}" for i in range(80)), "en", "new", 0),
        (900_002, "here is one more text of its own " + " ".join(f"r{i}" for i in range(80)), "en", "new", 0),
        (900_003, "here is one more text of its own " + " ".join(f"r{i}" for i in range(79)) + " other", "en", "new", 0),
        (900_004, " ".join(r["text"] for r in table(spark, FOLDER, "benchmark").orderBy("item_id").limit(2).collect()), "en", "new", 0),
    ], docs.schema)
    now, left = step(docs.union(planted).coalesce(2)), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = step(stage(spark, now, FOLDER))
        if k < 4:
            assert now.schema == before.schema
            left[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
            assert left[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
            assert 900_001 in left[name]
        if name == "n-gram Jaccard join":
            assert {k: v[1] for k, v in plain_join({r["doc_id"]: r["text"] for r in now.collect()}).items()} == {i: i for i in left[name]}
        if name == "benchmark decontamination":
            bench = table(spark, FOLDER, "benchmark")
            assert decontaminate.with_verdict(decontaminate.find(now, bench)).filter("contaminated").count() == 0
            lost = {r["doc_id"] for r in decontaminate.with_verdict(decontaminate.find(before, bench)).filter("contaminated").collect()}
            assert left["n-gram Jaccard join"] - left[name] == lost and 900_004 in lost
    assert 900_003 not in left["line dedup"]
    pieces = {r["doc_id"]: r["n"] for r in now.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert pieces == {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in before.collect()}
