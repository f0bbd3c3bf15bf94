"""Benchmark decontamination with an FM-index per training shard.

Words outside the test items' vocabulary cannot be part of an occurrence: a
shard's text keeps the runs of vocabulary words that are long enough for a
window, and one separator between runs. Every other word only counts. Over that
text each task builds an FM-index per shard of bounded size, finds all windows
by backward search, locates the occurrences, and merges them into removal spans
per document. Nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, carried, table, texts_of
from meguri.llm.fmindex import FMIndex
from meguri.llm.registry import query

# A-Z to a-z; every ASCII character but digits and letters to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Windows:
    """The distinct windows of a block of test items, as rows of word codes."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        index = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            row = [self.codes.setdefault(w, len(self.codes) + 2) for w in words(text)]
            for k in range(max(1, len(row) - width + 1) if row else 0):
                owners.setdefault(tuple(row[k : k + width]), set()).add(index[name])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for key in owners:
            by_length.setdefault(len(key), []).append(key)
        self.groups = [(np.array(keys, dtype=np.int64), [sorted(owners[k]) for k in keys]) for _, keys in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


_BUILT: dict[tuple[str, int], Windows] = {}


def _windows(key: str, items: Broadcast, width: int) -> Windows:
    """Built once a worker process; ``key`` is that of one block of one call."""
    if (key, width) not in _BUILT:
        _BUILT.clear()
        _BUILT[key, width] = Windows(items.value, width)
    return _BUILT[key, width]


class Shard:
    """Documents gathered until there is enough text for an index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.parts: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        split = [words(t) for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        first = len(self.counts)
        self.counts += sizes.tolist()
        if not self.windows.shortest or not sizes.sum():
            return
        get = self.windows.codes.get
        codes = np.concatenate([np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w)) for w in split])
        owner = np.repeat(np.arange(len(split)), sizes)
        word = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = codes > 0
        head = known.copy()
        head[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
        run = np.cumsum(head) - 1
        keep = known & (np.bincount(run[known], minlength=run[-1] + 2)[run] >= self.windows.shortest)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        # a separator before each run
        new = head[at]
        size = len(at) + int(new.sum())
        spot = np.arange(len(at)) + np.cumsum(new)
        part, where, own = np.ones(size, dtype=np.int64), np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        part[spot], where[spot], own[spot] = codes[at], word[at], owner[at] + first
        self.parts.append(part)
        self.where.append(where)
        self.owner.append(own)
        self.size += size

    def found(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Merged word spans and item names of each document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.counts]
        items: list[set[str]] = [set() for _ in self.counts]
        if not self.size:
            return spans, items
        text, where, owner = (np.concatenate(x) for x in (self.parts, self.where, self.owner))
        index = FMIndex(text, len(self.windows.codes) + 2)
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        for patterns, owners in self.windows.groups:
            low, high = index.search(patterns)
            times = high - low
            hit = np.flatnonzero(times)
            if not len(hit):
                continue
            which = np.repeat(hit, times[hit])
            rows = np.arange(len(which)) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit]) + np.repeat(low[hit], times[hit])
            at = index.locate(rows)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + patterns.shape[1], -1)
            for doc, window in np.unique(np.stack([owner[at], which]), axis=1).T.tolist():
                items[doc].update(self.windows.names[i] for i in owners[window])
        hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        if len(hit):
            doc, word = owner[hit], where[hit]
            cut = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(word) != 1)))
            stop = np.append(cut[1:], len(hit)) - 1
            for d, s, e in zip(doc[cut].tolist(), word[cut].tolist(), (word[stop] + 1).tolist()):
                spans[d].append((s, e))
        return spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _pass(docs: DataFrame, key: str, items: Broadcast, width: int, last: bool, shard_words: int) -> DataFrame:
    """One block of test items against all rows; what earlier blocks found is carried along."""
    others = [f.name for f in docs.schema if f.name not in ("_text", "n_words", "spans", "items")]
    carried = "spans" in docs.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, items, width)
        shard, held = Shard(windows), []

        def flush() -> Iterator[pa.RecordBatch]:
            spans, names = shard.found()
            done = 0
            for batch, n in held:
                s, i = spans[done : done + n], names[done : done + n]
                if carried:
                    s = [_merged([(x["start"], x["end"]) for x in old], new) for old, new in zip(batch.column("spans").to_pylist(), s)]
                    i = [new | set(old) for old, new in zip(batch.column("items").to_pylist(), i)]
                arrays = [batch.column(c) for c in others] + ([] if last else [batch.column("_text")])
                arrays += [
                    pa.array(shard.counts[done : done + n], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in s], _SPANS), pa.array([sorted(x) for x in i], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, *([] if last else ["_text"]), "n_words", "spans", "items"])
                done += n

        held_bytes = 0
        for batch in batches(frames):
            shard.add(texts_of(batch.column("_text")))
            kept = batch.drop_columns(["_text"]) if last else batch
            held.append((kept, batch.num_rows))
            held_bytes += kept.nbytes
            if shard.size >= shard_words or held_bytes >= 64 << 20:
                yield from flush()
                shard, held, held_bytes = Shard(windows), [], 0
        if held:
            yield from flush()

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ([] if last else ["_text string"]) + [_FOUND])
    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = 8 << 20, shard_words: int = 2_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry`` columns, n_words, merged word spans of occurrences and
    the items that occur, one row per row of ``docs``.

    A window is ``width`` consecutive words of an item, or a whole shorter item.
    Test items are sent to tasks in blocks of about ``block_bytes`` of text, one
    pass a block, so the bound on a broadcast holds for any number of items. Null
    or empty text has no words and no spans; null or empty items have no windows;
    an item without an id still marks words but names nothing. No items: no spans;
    no documents: no rows. Very long texts are read whole. Rows are judged one by
    one, so repeated rows and null ids change nothing. A ``carry`` column named like
    a column of the result comes back with ``doc_`` before its name.
    """
    spark = docs.sparkSession
    test = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = test.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    extra, names = carried(docs, carry, ("doc_id", "n_words", "spans", "items", "n_hit", "contaminated"))
    out = docs.select(F.col("doc_id"), *extra, F.col("text").alias("_text"))
    for k in range(n):
        rows = test.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        items = spark.sparkContext.broadcast([("" if r["item_id"] is None else f"={r['item_id']}", r["text"]) for r in rows])
        out = _pass(out, uuid.uuid4().hex, items, width, k == n - 1, shard_words)
    out = out.withColumn("items", F.transform(F.filter("items", lambda i: i != ""), lambda i: F.substring(i, 2, 1 << 30)))
    return out.toDF("doc_id", *names, "n_words", "spans", "items")


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit, and at least one in twenty."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


@query("op5_benchmark_fm_index")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = with_verdict(find(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
