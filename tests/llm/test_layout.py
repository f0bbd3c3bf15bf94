"""Packing, sharding and numbering."""

import random
import zlib

import numpy as np

from meguri.llm import packing, sharding
from meguri.llm.common import numbered, table

FOLDER = "/root/testdata/sf0.001"


def least_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    n = len(sizes)
    best = [0 if j == n else float("inf") for j in range(n + 1)]
    for _ in range(shards):
        best = [min(max(ends[e] - ends[j], best[e]) for e in range(j, n + 1)) for j in range(n + 1)]
    return best[0]


def test_minimax_against_all_partitions():
    rng = random.Random(1)
    for _ in range(300):
        sizes, shards = [rng.randint(1, 20) for _ in range(rng.randint(0, 14))], rng.randint(1, 6)
        a = np.array(sizes, dtype=np.int64)
        want = least_capacity(sizes, shards) if sizes else 0
        assert sharding.smallest_capacity(a, shards) == want
        cuts = sharding.cuts(a, shards)
        assert len(cuts) == shards and cuts[0] == 0 and cuts == sorted(cuts)
        assert max((int(a[s:e].sum()) for s, e in zip(cuts, [*cuts[1:], len(sizes)])), default=0) <= want


def test_shards_of_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    got = sharding.op4(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    groups, total, largest, slots = {}, {}, {}, {}
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert groups.setdefault(data, r["shard"]) == r["shard"] and 0 <= r["shard"] < 40
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        largest[data] = largest.get(data, 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) <= sum(total.values()) / 40 + max(largest.values())


def test_shards_are_minimal_over_single_groups(spark):
    """Few groups: every unit is one group, so the capacity is the least there is."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 400) + str(i // 2)) for i in range(120)], "doc_id long, text string")
    hashed = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(cast(text as binary)) h").collect()}
    got = sharding.assign(docs, 7).collect()
    groups = {}
    for r in got:
        groups[hashed[r["doc_id"]] % 2**64] = groups.get(hashed[r["doc_id"]] % 2**64, 0) + r["size"]
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert max(total.values()) == least_capacity([groups[k] for k in sorted(groups)], 7)


def test_shards_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "a", 3), (3, "a", 3), (None, None, 1), (5, "é" * 50_000, 1)], "doc_id long, text string, shard int")
    got = sharding.assign(docs).collect()
    assert len(got) == 6 and sorted(r["size"] for r in got) == [16, 16, 16, 17, 17, 100_016]
    assert len({r["shard"] for r in got if r["size"] == 16}) == 1
    assert sharding.assign(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(5000)], "doc_id long, text string").repartition(7)
    rows = sharding.assign(same).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(5000))


def test_numbered(spark):
    for groups in ([0] * 300, [i // 50 for i in range(300)], [i % 7 if i % 7 else None for i in range(300)], list(range(300)), [0] * 290 + list(range(1, 11)), []):
        df = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "g int, o int").repartition(5)
        seen = {}
        for r in numbered(df, "g", ["g", "o"], "k").collect():
            seen.setdefault(r["g"], []).append((r["o"], r["k"]))
        assert sum(map(len, seen.values())) == len(groups)
        assert all([k for _, k in sorted(v)] == list(range(len(v))) for v in seen.values())


# -- packing ------------------------------------------------------------------
def test_best_fit():
    where, bins = packing.packed([60, 50, 40, 30, 20], (100,))
    assert where == [0, 1, 0, 1, 1] and bins == [100, 100]
    assert packing.best_packing([], (10,)) == ([], [])


def test_downsizing_and_joint_choice():
    lengths = sorted([8000] * 5 + [100] * 5, reverse=True)
    where, final = packing.best_packing(lengths, (128, 1024, 8192))
    full = np.bincount(where, weights=lengths)
    assert all(size == min(s for s in (128, 1024, 8192) if s >= f) for size, f in zip(final, full))
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 4096) for _ in range(300)), reverse=True)
        cost = lambda sizes: sum(packing.cost(s) for s in packing.best_packing(lengths, sizes)[1])
        assert cost((512, 1024, 2048, 4096)) <= cost((4096,)) + 1e-6


def whole(rows, lengths, sizes):
    """Every token of every row in one bin, no bin over its capacity, capacities as small as they can be."""
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for members in bins.values():
        members.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in members])
        assert [r["offset"] for r in members] == [0, *ends[:-1].tolist()]
        assert {r["capacity"] for r in members} == {min(s for s in sizes if s >= ends[-1])}
    got = sorted((i, sum(n for _, n in p)) for i, p in pieces.items())
    assert got == sorted(lengths.items())
    return sum(lengths.values()) / sum(m[0]["capacity"] for m in bins.values())


def test_packing_documents(spark):
    docs = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in table(spark, FOLDER, "documents").collect()}
    assert whole(packing.op2(spark, FOLDER).collect(), docs, packing.SIZES) > 0.9


def test_packing_blocks_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97), i) for i in range(2000)], "doc_id long, text string, bin long")
    assert whole(packing.pack(docs, (32, 64, 128), block=300).collect(), {i: i % 97 + 1 for i in range(2000)}, (32, 64, 128)) > 0.85
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "é" * 100), (2, "é" * 100)], "doc_id long, text string")
    rows = packing.pack(odd, (16, 64)).collect()
    assert sum(r["length"] for r in rows) == 1 + 1 + 201 + 201 and len(rows) == 2 + 4 + 4
    assert sorted(r["start"] for r in rows if r["doc_id"] == 2) == [0, 0, 64, 64, 128, 128, 192, 192]
    assert packing.pack(odd.limit(0)).count() == 0
