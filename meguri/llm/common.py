"""Reading, row numbers, steps on shared storage and word codes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = f"file:/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there
    and the rows survive the loss of an executor.

    What was shuffled for it goes with the end of the write. Otherwise it lies on the executors' disks
    until the driver happens to collect its garbage, so that a job holds the shuffles of many steps.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def only_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them again in the filter:
    Spark would move the filter below them as a copy, but not past this."""
    return df.withColumn("_here", F.spark_partition_id()).filter(condition & (F.col("_here") >= 0)).drop("_here")


def maybe(rows: DataFrame, wanted: DataFrame, words: int = 1 << 20) -> DataFrame:
    """Those of ``rows`` whose id, a hash, may be in ``wanted`` (id): all that are, and some others.

    A table of ``words`` * 64 bits, 16 MB whatever the number of ids, is sent to every task, so
    that most other rows are not shuffled; beyond its size it only spares less.
    """
    word = lambda c: c.bitwiseAND(F.lit(words - 1))
    bit = lambda c: F.shiftright(c, 20).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("id")))
    bits = wanted.groupBy(word(F.col("id")).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    marked = rows.withColumn("_word", word(F.col("id"))).join(F.broadcast(bits), "_word")
    return marked.filter(F.col("_bits").bitwiseAND(one) != 0).select(*rows.columns)


def no_rows(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def sampled(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, picked by a hash of ``key``; for fitting only."""
    total = df.count()
    if total <= rows:
        return df
    share = 1 << 40
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(share)) < int(share * 0.9 * rows / total)).limit(rows)


def texts_of(column: pa.Array) -> list[str]:
    """The column's texts; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def batches(frames: Iterable[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that what a task
    holds follows neither the row count nor the mean row."""
    for batch in frames:
        n = batch.num_rows
        rows = max(1, int(n * size / max(1, batch.nbytes)))
        for start in range(0, n, rows):
            yield batch.slice(start, rows)


_ONE = np.uint64(0xBF58476D1CE4E5B9)
_TWO = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit (splitmix finish)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _ONE
        x = (x ^ (x >> np.uint64(27))) * _TWO
        return x ^ (x >> np.uint64(31))


def word_codes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(start of each text's words, code of each word, word of each code)."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(int(starts[-1]), dtype=object)
    for i, w in enumerate(words):
        flat[starts[i] : starts[i + 1]] = w
    codes, unique = pd.factorize(flat)
    return starts, codes.astype(np.int64), list(unique)


def checked_schema(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the named columns, so that others cannot clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... without a gap within each ``group``, in ``order``,
    which must start with what sorts the groups and leave no ties.

    Rows are dealt to tasks by range, so one group of any size may span many
    tasks. Each task numbers its rows as a stream; a group that goes on from
    the task before starts where that one stopped, which takes the counts of each
    task's first and last group only.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in frames:
            of = batch.column(group).to_pylist()
            place = np.empty(len(of), dtype=np.int64)
            for i, value in enumerate(of):
                seen = seen + 1 if value == last else 0
                place[i], last = seen, value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "_place"])

    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = step(dealt.mapInArrow(run, f"{schema}, _place long"), "placed")
    wrapped = F.struct(F.col(group).alias("g"))  # a null group counts as one
    by_order = F.struct(*order, wrapped.alias("w"))
    ends = placed.groupBy("_task").agg(F.min(by_order)["w"].alias("first"), F.max(by_order)["w"].alias("last"))
    found = placed.join(F.broadcast(ends), "_task").filter((wrapped == F.col("first")) | (wrapped == F.col("last")))
    counts = found.groupBy("_task", "first", "last").agg(
        F.count(F.when(wrapped == F.col("first"), 1)).alias("in_first"), F.count(F.when(wrapped == F.col("last"), 1)).alias("in_last")
    ).collect()  # one row a task
    ahead, last, total = [], object(), 0
    for r in sorted(counts, key=lambda r: r["_task"]):
        if r["first"] == last:
            ahead.append((r["_task"], r["first"]["g"], total))
        whole = r["first"] == r["last"] == last
        last, total = r["last"], r["in_last"] + (total if whole else 0)
    kind = rows.schema[group].dataType.simpleString()
    known = spark.createDataFrame(ahead, f"_t int, _g {kind}, _ahead long")
    return placed.join(F.broadcast(known), (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")), "left").select(
        *rows.columns, (F.col("_place") + F.coalesce("_ahead", F.lit(0))).alias(name)
    )


def carried(docs: DataFrame, carry: Sequence[str], own: Sequence[str]) -> tuple[list[Column], list[str]]:
    """(the ``carry`` columns under names that no operator uses, their names in its
    result). A name that is among ``own``, in any case, gets ``doc_`` before it until it's free."""
    taken, names = {o.lower() for o in own}, []
    for name in carry:
        while name.lower() in taken:
            name = f"doc_{name}"
        taken.add(name.lower())
        names.append(name)
    return [F.col("`{}`".format(c.replace("`", "``"))).alias(f"_carried_{k}") for k, c in enumerate(carry)], names
