"""Parities of sets, the bits sent to every task, and shared buckets."""

from collections import defaultdict

import numpy as np
import pytest

from meguri.llm import ngram_join
from meguri.llm.common import maybe


@pytest.mark.parametrize("sizes", [(0, 1, 5, 400), (3000, 0, 2)])
def test_parities_differ_no_more_than_sets(sizes):
    rng = np.random.default_rng(len(sizes))
    sets = [rng.choice(1 << 20, n, replace=False).astype(np.uint64) for n in sizes for _ in range(2)]
    sets.append(np.concatenate([sets[-3][:1], sets[-1]]))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = ngram_join.parities(starts, np.concatenate(sets)).view(np.uint64)
    assert bits.shape == (len(sets), ngram_join.PARITY)
    for x, a in zip(sets, bits):
        for y, b in zip(sets, bits):
            apart = sum(bin(int(w)).count("1") for w in a ^ b)
            assert apart <= len(set(x.tolist()) ^ set(y.tolist()))
            assert apart % 2 == (len(x) + len(y)) % 2


def test_no_sets_have_no_parities():
    assert ngram_join.parities(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64)).shape == (0, ngram_join.PARITY)


def test_maybe_loses_no_row(spark):
    rows = spark.range(0, 3000).selectExpr("xxhash64(id) AS id", "id AS x")
    wanted = spark.range(0, 3000, 7).selectExpr("xxhash64(id) AS id")
    for words in (1 << 20, 4):  # the second is soon full: it spares less and loses nothing
        got = {r["x"] for r in maybe(rows, wanted, words).collect()}
        assert got >= set(range(0, 3000, 7))
    assert maybe(rows, wanted.limit(0)).count() == 0 and maybe(rows, wanted).columns == ["id", "x"]


def test_buckets_counted_where_they_lie(spark):
    crowd = ngram_join.CROWD
    held = [(1, k) for k in range(crowd)] + [(2, k) for k in range(crowd + 1)] + [(3, 5)] + [(4, 1), (4, 2), (4, 1)]
    got = defaultdict(list)
    for r in ngram_join._counted(spark.createDataFrame(held, "bucket long, id long")).collect():
        got[r["bucket"]].append((r["own"], list(r["ids"])))
    assert got[1] == [(None, list(range(crowd)))] and got[4] == [(None, [1, 2])] and 3 not in got
    assert sorted(got[2]) == [(k, [k]) for k in range(crowd + 1)]


def test_signatures_leave_bytes_empty():
    """What is shuffled most: zeros ahead of the hash, and different signatures all the same."""
    rng = np.random.default_rng(7)
    values = rng.choice(1 << 62, 40_000, replace=False).astype(np.uint64)
    starts = np.arange(0, 40_001, 200)
    bands = ngram_join.Bands()
    of, sigs = ngram_join.signatures(starts, values, bands)
    assert len(of) > 10_000
    assert sigs.min() >= 0 and sigs.max() < 1 << (ngram_join.MARK + 8)
    assert len(np.unique(sigs)) == len(sigs)
    assert set((sigs & 255).tolist()) == {int(bands.band(np.array([200]))[0]) - k for k in (0, 1)}


def test_a_set_gives_no_more_signatures_than_it_needs():
    """k + 1 and a few in each band; linked sets share all but k of what either one gives."""
    rng = np.random.default_rng(11)
    bands, sets = ngram_join.Bands(), []
    for size in (3, 9, 40, 200, 1000):
        for _ in range(4):
            x = rng.choice(1 << 62, size, replace=False).astype(np.uint64)
            apart = rng.integers(0, size // 9 + 1)  # so many of either set are its own
            sets += [x, np.concatenate([x[apart:], rng.choice(1 << 62, apart, replace=False).astype(np.uint64)])]
    starts, values = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)
    own = bands.band(np.diff(starts))
    of, sigs = ngram_join.signatures(starts, values, bands)
    spare, _ = ngram_join.spares(starts, values, bands)
    given = defaultdict(set)
    for i, s in zip(of.tolist(), sigs.tolist()):
        given[i, s & 255].add(s)
    assert all(len(g) <= bands.differ[b] + 1 + bands.more[b] for (_, b), g in given.items())
    large = [i for i in range(len(sets)) if len(sets[i]) == 1000]
    assert all(len(given[i, int(own[i])]) == bands.differ[own[i]] + 1 + bands.more[own[i]] < bands.parts[own[i]] for i in large)
    for i in range(0, len(sets), 2):  # of one size, so they meet in their own band
        b = int(own[i])
        if bands.differ[b]:
            assert len(given[i, b] & given[i + 1, b]) >= max(spare[i], spare[i + 1]) + 1
