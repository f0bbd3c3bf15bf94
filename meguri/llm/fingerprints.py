"""Document fingerprints by a homomorphic hash of the multiset of paragraphs.

A paragraph is a line that is not empty. It is hashed to a wide vector: EXACT
lanes spread from 128 bits of its hash, added modulo 2^64, and ALIKE lanes, added modulo
2^32, in which each run of three of its words counts 1 or -1 in a lane by its hash. A document's
fingerprint is the sum over its paragraphs. So the order of paragraphs does not matter, and
paragraphs are put in or taken out by adding or subtracting their vectors.

Equal multisets have equal sums. The ALIKE lanes are a linear sketch: the inner product
of two documents' lanes estimates that of their counts of word runs, from which comes a
likeness of 0 to 1, with a standard error of about 1/16 for unrelated texts.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, mixed, table, texts_of, word_codes
from meguri.llm.csr import spread
from meguri.llm.registry import query

EXACT, ALIKE = 8, 256  # lanes
RUN = 3  # words
SHARES = 8  # stretches of documents to a task
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Sums:
    """A fingerprint a row: ``exact`` (uint64) and ``alike`` (int32, so modulo 2^32)."""

    def __init__(self, exact: np.ndarray, alike: np.ndarray):
        self.exact, self.alike = exact, alike

    def __getitem__(self, rows) -> Sums:
        return Sums(self.exact[rows], self.alike[rows])

    def __add__(self, other: Sums) -> Sums:
        with np.errstate(over="ignore"):
            return Sums(self.exact + other.exact, self.alike + other.alike)

    def __sub__(self, other: Sums) -> Sums:
        with np.errstate(over="ignore"):
            return Sums(self.exact - other.exact, self.alike - other.alike)

    def written(self) -> list[str]:
        return [base64.b64encode(x.astype("<u8").tobytes() + y.astype("<i4").tobytes()).decode() for x, y in zip(self.exact, self.alike)]


def read(written: list[str]) -> Sums:
    """Fingerprints from their written form."""
    data = [base64.b64decode(w) for w in written]
    exact = np.array([np.frombuffer(d[: 8 * EXACT], dtype="<u8") for d in data], dtype=np.uint64).reshape(-1, EXACT)
    return Sums(exact, np.array([np.frombuffer(d[8 * EXACT :], dtype="<i4") for d in data], dtype=np.int32).reshape(-1, ALIKE))


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def summed(paragraph_lists: list[list[str]]) -> Sums:
    """The sum over each list's paragraphs."""
    n = len(paragraph_lists)
    counts = np.array([len(p) for p in paragraph_lists], dtype=np.int64)
    data = [p.encode("utf-8", "surrogatepass") for ps in paragraph_lists for p in ps]
    owner = np.repeat(np.arange(n), counts)
    exact, alike = np.zeros((n, EXACT), dtype=np.uint64), np.zeros(n * ALIKE, dtype=np.int64)
    if not data:
        return Sums(exact, alike.reshape(n, ALIKE).astype(np.int32))
    hashed = np.frombuffer(b"".join([xxhash.xxh3_128_digest(d) for d in data]), dtype="<u8").reshape(-1, 2)
    some = np.flatnonzero(counts)
    with np.errstate(over="ignore"):
        for lane in range(EXACT):
            values = mixed(mixed(hashed[:, 0] + np.uint64(lane) * _STEP) + hashed[:, 1])
            exact[some, lane] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
        starts, codes, unique = word_codes([d.split() for d in data])
        sizes = np.diff(starts)
        of_word = np.array([xxhash.xxh64_intdigest(w) for w in unique], dtype=np.uint64)[codes] if unique else np.zeros(0, dtype=np.uint64)
        runs = np.where(sizes > RUN, sizes - RUN + 1, np.minimum(sizes, 1))  # fewer words make one run
        at = spread(starts[:-1], runs)
        left = np.repeat(starts[1:], runs) - at
        h = of_word[at]
        for k in range(1, RUN):
            there = left > k
            h = mixed(h) * _STEP + np.where(there, of_word[np.where(there, at + k, at)], np.uint64(k))
        h = mixed(h)
    place = np.repeat(owner, runs) * ALIKE + (h % np.uint64(ALIKE)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    alike += np.bincount(place, sign, len(alike)).astype(np.int64)
    return Sums(exact, alike.reshape(n, ALIKE).astype(np.int32))


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """2 <x, y> / (<x, x> + <y, y>) of the ALIKE lanes, within 0 and 1; 1 for equal
    fingerprints, 0 for different ones without any word."""
    x, y = a.alike.astype(np.float64), b.alike.astype(np.float64)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(2 * (x * y).sum(axis=1) / np.maximum(both, 1), 0, 1)
    return np.where((a.exact == b.exact).all(axis=1) & (a.alike == b.alike).all(axis=1), 1.0, near)


def changed(before: Sums, taken: list[list[str]], put: list[list[str]]) -> Sums:
    """Fingerprints after each row lost the paragraphs ``taken`` and got those ``put``."""
    return before - summed(taken) + summed(put)


def edit(text: str, following: str) -> tuple[str, list[str], list[str]]:
    """(edited text, paragraphs taken, paragraphs put): the last quarter of the characters
    gives way to as many from the beginning of the next text, or all it has."""
    quarter = len(text) // 4
    if not quarter:
        return text, [], []
    cut = len(text) - quarter
    new = text[:cut] + following[:quarter]
    first = text.rfind("\n", 0, cut) + 1  # of the paragraph that the cut lies in
    return new, paragraphs(text[first:]), paragraphs(new[first:])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, a row per row of ``docs``.

    Null and empty texts have no paragraph: all lanes are 0. Rows are read one by one, whole; repeated
    rows and null ids change nothing; other columns are not read. No rows: no rows.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = summed([paragraphs(t) for t in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.written(), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _key(doc_id, row: int) -> tuple:
    return doc_id is not None, 0 if doc_id is None else doc_id, row


def first_keys(rows: DataFrame) -> list[tuple]:
    """The first (doc_id, row) of each of SHARES stretches a task, in order: what
    the driver holds follows the number of tasks. ``rows`` has doc_id and row."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, rows.count() // (SHARES * max(tasks, rows.rdd.getNumPartitions())))
    order = ["doc_id", "row"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in frames:
            yield batch.take(pa.array(np.arange(-seen % size, batch.num_rows, size)))
            seen += batch.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return sorted(_key(*r) for r in dealt.mapInArrow(run, f"doc_id {kind}, row long").collect())


def beside_next(docs: DataFrame) -> DataFrame:
    """stretch, copy, doc_id, row and text: each stretch of documents in order of (doc_id, row)
    within one partition, and behind it, as a copy, the first of the next stretch.

    Texts are shuffled once. The next of the last document is the first one.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    heads = first_keys(rows)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(heads)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = sent.value
        for batch in batches(frames):
            keys = [_key(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            stretch = [bisect_right(heads, k) - 1 for k in keys]
            first = [i for i, (k, s) in enumerate(zip(keys, stretch)) if heads[s] == k]
            taken = batch.take(pa.array([*range(len(keys)), *first], pa.int64()))
            stretch += [(stretch[i] - 1) % len(heads) for i in first]
            copy = [False] * len(keys) + [True] * len(first)
            yield from batches([pa.RecordBatch.from_arrays(
                [pa.array(stretch, pa.int64()), pa.array(copy, pa.bool_()), *taken.columns], names=["stretch", "copy", "doc_id", "row", "text"])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.mapInArrow(run, f"stretch long, copy boolean, doc_id {kind}, row long, text string")
    return dealt.repartition(tasks, "stretch").sortWithinPartitions("stretch", "copy", "doc_id", "row")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, a row per row of ``docs``; see ``edit``.

    The edited text's fingerprint comes from the text's own by taking out and
    putting in the paragraphs from the cut on. Documents follow each other by doc_id,
    null ids first, equal ids by their place in the input, which must be the same
    whenever it is read, as of files and written steps. The only document follows
    itself. Null text is empty. A task holds about 4 MB of texts and the longest one. Other columns are not
    read. No rows: no rows.
    """
    def rows_of(stretch: list, copy: list, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        here = [i for i in range(len(texts) - 1) if stretch[i] == stretch[i + 1] and not copy[i]]
        own = summed([paragraphs(t) for t in texts])
        new, taken, put = zip(*(edit(texts[i], texts[i + 1]) for i in here)) if here else ((), (), ())
        at = np.array(here, dtype=np.int64)
        after = changed(own[at], list(taken), list(put))
        return pa.RecordBatch.from_arrays([
            ids.take(pa.array(at)), pa.array([len(texts[i]) for i in here], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
            pa.array(own[at].written(), pa.string()), pa.array(after.written(), pa.string()),
            pa.array(likeness(own[at], after)), pa.array(likeness(own[at], own[at + 1])),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its next one
        for batch in batches(frames):
            whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()
            if whole:
                found = whole[0]
                yield rows_of(found.column("stretch").to_pylist(), found.column("copy").to_pylist(), found.column("doc_id"), texts_of(found.column("text")))
                last = found.slice(found.num_rows - 1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return beside_next(docs).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op13_document_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return edited(table(spark, folder, "documents"))
