"""Severity of toxic text by cumulative-link ordinal regression.

Features are hashed words and word beginnings; one weight for each is shared by
all thresholds: the chance of grade k or
more is logistic(w.x - t_k) with t_1 < t_2 < ...; the expected severity is the
sum of these chances. The labels say only toxic or not, so grades are derived:
0 for not toxic, and toxic texts are split evenly by how dense they are in words
that mark toxic texts of the fitted sample, 1 for the milder part and 2 for the
rest. ``fit_grades`` takes any grades.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, carried, sampled, step, table, texts_of, word_codes
from meguri.llm.decontaminate import words
from meguri.llm.registry import query

DIMENSIONS = 1 << 20


def stems(word: bytes) -> list[int]:
    """Hashes of a word and of its first 3 to 7 characters, if it is longer."""
    text = word.decode("utf-8", "replace")
    parts = [f"={text}", *(f"{text[:n]}-" for n in range(3, min(8, len(text))))]
    return [xxhash.xxh64_intdigest(p) % DIMENSIONS for p in parts]


def sparse(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the features that occur, and words per text; the
    value is log(1 + times). ``wanted`` says which features count, if not all."""
    starts, codes, unique = word_codes([words(t) for t in texts])
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lists = [stems(w) for w in unique]
    many = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((f for x in lists for f in x), dtype=np.int64, count=int(many.sum()))
    if wanted is not None:
        keep = wanted[flat]
        many = np.bincount(np.repeat(np.arange(len(many)), many)[keep], minlength=len(many))
        flat = flat[keep]
        some = many[codes] > 0
        codes, owner = codes[some], owner[some]
    times = many[codes]
    first = np.cumsum(many) - many
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[codes], times)
    both, count = np.unique(np.repeat(owner, times) * np.int64(DIMENSIONS) + flat[at], return_counts=True)
    return both // DIMENSIONS, both % DIMENSIONS, np.log1p(count), sizes


def likelihood_ratio(texts: np.ndarray, yes: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """Twice the log of how much likelier the labels are with a feature than by
    chance, for features of ``texts`` texts, ``yes`` of them labelled yes."""
    total = np.zeros(len(texts))
    for got, row, col in (
        (yes, texts, positive), (texts - yes, texts, rows - positive), (positive - yes, rows - texts, positive),
        (rows - positive - texts + yes, rows - texts, rows - positive),
    ):
        expected = row * col / max(rows, 1)
        total += np.where(got > 0, got * np.log(np.maximum(got, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return 2 * total


def telling(text: np.ndarray, column: np.ndarray, n: int, yes: np.ndarray, least_texts: int, least: float) -> np.ndarray:
    """Which columns tell the labels apart: in enough texts, and likely enough."""
    texts, both = np.bincount(column, minlength=n).astype(float), np.bincount(column, yes[text], n)
    return (texts >= least_texts) & (likelihood_ratio(texts, both, len(yes), int(yes.sum())) >= least)


class Ordinal:
    """Cumulative-link model; ``grades`` counts from 0."""

    def __init__(self, grades: int, l2: float = 0.3, rounds: int = 200, rate: float = 0.1, least_texts: int = 5, least_ratio: float = 12.0):
        self.grades, self.l2, self.rounds, self.rate = grades, l2, rounds, rate
        self.least_texts, self.least_ratio = least_texts, least_ratio
        self.weights = np.zeros(DIMENSIONS, dtype=np.float32)
        self.thresholds = np.arange(grades - 1) + 30.0  # before a fit, everything is grade 0
        self.cut = 0.5

    def _rank(self, gaps: np.ndarray) -> np.ndarray:
        return np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))])

    def fit(self, text: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray) -> Ordinal:
        """Adam on the whole sample, over features that tell grade 0 from others."""
        n = len(grade)
        if n == 0 or len(np.unique(grade)) < 2:
            return self
        used, column = np.unique(word, return_inverse=True)
        often = telling(text, column, len(used), grade > 0, self.least_texts, self.least_ratio)
        keep = often[column]
        number = np.cumsum(often) - 1
        text, column, value, used = text[keep], number[column[keep]], value[keep], used[often]
        top = self.grades - 1
        share = np.clip([(grade >= k).mean() for k in range(1, self.grades)], 1e-3, 1 - 1e-3)
        start = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(top) * 1e-3)
        gaps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
        w = np.zeros(len(used))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, gaps)]
        for t in range(1, self.rounds + 1):
            theta = self._rank(gaps)
            s = np.bincount(text, value * w[column], n)
            above = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -40, 40))), np.zeros(n)])
            here, over = above[np.arange(n), grade], above[np.arange(n), grade + 1]
            chance = np.maximum(here - over, 1e-9)
            slope = 1 - here - over  # of the log chance
            gw = -np.bincount(column, value * slope[text], len(w)) / n + self.l2 * w / n
            gt = np.zeros(top)
            np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, here * (1 - here) / chance, 0) / n)
            np.add.at(gt, np.minimum(grade, top - 1), np.where(grade < top, -over * (1 - over) / chance, 0) / n)
            gg = np.cumsum(gt[::-1])[::-1].copy()
            gg[1:] *= np.exp(gaps[1:])
            for p, g, (m, v) in zip((w, gaps), (gw, gg), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights[used] = np.where(np.abs(w) < 1e-3, 0, w)
        self.thresholds = self._rank(gaps)
        return self

    def chances(self, text: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """(texts, grades - 1): the chance of at least grade 1, 2, ..."""
        s = np.bincount(text, value * self.weights[word], n)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -40, 40)))


def graded(text: np.ndarray, word: np.ndarray, value: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, marks: int = 50) -> np.ndarray:
    """Grades 0, 1, 2 from yes/no labels: see the module's text."""
    yes, n = toxic > 0, len(toxic)
    used, column = np.unique(word, return_inverse=True)
    in_yes = np.bincount(column, yes[text], len(used))
    in_no = np.bincount(column, ~yes[text], len(used))
    odds = np.log((in_yes + 1) / (yes.sum() + 2)) - np.log((in_no + 1) / (n - yes.sum() + 2))
    odds[in_yes < 5] = -np.inf
    marking = np.zeros(len(used), dtype=bool)
    best = np.argsort(-odds, kind="stable")[:marks]
    marking[best[odds[best] > 1]] = True
    dense = np.bincount(text, np.expm1(value) * marking[column], n) / np.maximum(sizes, 1)
    grade = yes.astype(np.int64)
    if yes.any():
        grade[yes & (dense > np.median(dense[yes]))] = 2
    return grade


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 20_000, precision: float = 0.98) -> Ordinal:
    """The model of at most ``max_rows`` labelled texts of at most ``max_chars``
    characters, picked by a hash of the id. A fifth of them sets ``cut``, the
    least chance of grade 1 at which held-out precision is met; 0.2 at least.

    A doc_id with several labels is toxic if any says so; null ids and labels are
    left out. No labels, or all alike: a model by which everything is grade 0.
    """
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sampled(said, max_rows, "doc_id")  # so a broadcast of it is bounded
    rows = docs.filter(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(picked), "doc_id").limit(2 * max_rows)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            text, word, value, sizes = sparse(texts_of(batch.column("text")))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            ids = batch.column("doc_id").cast(pa.string())
            held = [xxhash.xxh64_intdigest(i) % 5 == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([
                ids, batch.column("toxic").cast(pa.int64()), pa.array(sizes), pa.array(held, pa.bool_()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value, pa.float32())),
            ], names=["id", "toxic", "size", "held", "word", "value"])

    # the sample stays with Spark; the driver gets counts of features, then only those that tell
    read = step(rows.mapInArrow(run, "id string, toxic long, size long, held boolean, word array<int>, value array<float>"), "labelled")
    fitted = read.filter(~F.col("held"))
    seen = fitted.select("toxic", F.explode("word").alias("word")).groupBy("word").agg(
        F.count("*").alias("texts"), F.count(F.when(F.col("toxic") > 0, 1)).alias("yes")).filter(F.col("texts") >= Ordinal(3).least_texts).toArrow()
    total = fitted.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") > 0, 1)).alias("yes")).first()
    model = Ordinal(3)
    texts, yes = (seen.column(c).to_numpy().astype(float) for c in ("texts", "yes"))
    wanted = np.zeros(DIMENSIONS, dtype=bool)
    wanted[seen.column("word").to_numpy()[likelihood_ratio(texts, yes, total["n"], total["yes"]) >= model.least_ratio]] = True

    def telling_only(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keep = [(w, wanted[w]) for w in (np.array(x, dtype=np.int64) for x in batch.column("word").to_pylist())]
            word = pa.array([w[k] for w, k in keep], pa.list_(pa.int32()))
            value = pa.array([np.array(v, dtype=np.float32)[k] for v, (_, k) in zip(batch.column("value").to_pylist(), keep)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "toxic", "size", "held")), word, value], names=["id", "toxic", "size", "held", "word", "value"])

    got = read.mapInArrow(telling_only, read.schema).toArrow()
    if not got.num_rows:
        return model
    got = got.sort_by([("id", "ascending"), ("size", "ascending")])
    toxic, sizes, held = (got.column(c).to_numpy() for c in ("toxic", "size", "held"))
    lists, value = got.column("word").combine_chunks(), got.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    counts = np.diff(lists.offsets.to_numpy())
    text, word = np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy().astype(np.int64)
    number, train = np.cumsum(~held) - 1, ~held[text]
    grade = graded(text, word, value, sizes, toxic)
    model.fit(number[text[train]], word[train], value[train], grade[~held])
    if held.any():
        p = model.chances(text, word, value, len(toxic))[held, 0]
        yes = toxic[held] > 0
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(yes[order]) / np.arange(1, len(p) + 1)
        good = np.flatnonzero((share >= precision) & np.append(p[order][1:] < p[order][:-1], True))
        model.cut = max(0.2, float(p[order][good[-1]])) if len(good) else 0.5
    return model


def score(docs: DataFrame, model: Ordinal, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry`` columns, severity (expected), p_1, p_2, ... (chance of
    that grade or more), grade (most of them at least even) and rejected (p_1 at
    or above the model's cut), one row per row of ``docs``.

    Null or empty text: judged by the thresholds alone, like a text without any telling word.
    Rows are judged one by one; repeated rows, null ids and order change nothing.
    No rows: no rows. Very long texts are read whole. A ``carry`` column named like a
    column of the result comes back with ``doc_`` before its name.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # DIMENSIONS floats
    names = [f"p_{k}" for k in range(1, model.grades)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches(frames):
            text, word, value, _ = sparse(texts_of(batch.column("_text")), model.weights != 0)
            p = model.chances(text, word, value, batch.num_rows)
            new = [pa.array(p.sum(axis=1)), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array((p >= 0.5).sum(axis=1)), pa.array(p[:, 0] >= model.cut)]
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept.schema.names, "severity", *names, "grade", "rejected"])

    new_names = ("severity", *names, "grade", "rejected")
    extra, kept_names = carried(docs, carry, ("doc_id", *new_names))
    rows = docs.select("doc_id", *extra, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    scored = rows.mapInArrow(run, f"{schema}, severity double, {', '.join(f'{n} double' for n in names)}, grade long, rejected boolean")
    return scored.toDF("doc_id", *kept_names, *new_names)


@query("op10_ordinal_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = score(docs, fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_1", 6).alias("p_1"), F.round("p_2", 6).alias("p_2"), "grade", "rejected")
