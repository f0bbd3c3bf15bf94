"""Running combinations over ordered pieces of a group of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meguri.llm.common import step

FAN = 256  # pieces that one row puts together


def exclusive(pieces: DataFrame, combine: Callable[[list[int], list[int]], list[int]], whole: list[int], reverse: bool = False) -> DataFrame:
    """(key, k, before): for each of ``pieces`` (key, k, value), numbered 0, 1, ... within
    a key, all values before it (or after it: ``reverse``) put together in order.

    ``combine`` is associative with the neutral value ``whole``. Pieces are put together FAN
    at a time, level by level, and the outcomes handed down again: no row holds
    more than FAN pieces, whatever the size of a key. Values are lists of whole numbers.
    """
    def lists(level: DataFrame) -> DataFrame:
        up = F.floor(F.col("k") / FAN).cast("long")
        return level.groupBy("key", up.alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("values"))

    def folded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = []
            for values in batch.column("values").to_pylist():
                total = whole
                for v in values:
                    total = combine(total, v)
                out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(out, pa.list_(pa.int64()))], names=["key", "k", "value"])

    def handed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keys, places, found = [], [], []
            for key, k, values, before in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "values", "before"))):
                order = range(len(values) - 1, -1, -1) if reverse else range(len(values))
                for i in order:
                    keys.append(key)
                    places.append(k * FAN + i)
                    found.append(before)
                    before = combine(values[i], before) if reverse else combine(before, values[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "k", "before"])

    levels = [step(pieces.select("key", "k", F.col("value").cast("array<long>").alias("value")), "level")]
    while not levels[-1].filter("k > 0").isEmpty():
        levels.append(step(lists(levels[-1]).mapInArrow(folded, "key string, k long, value array<long>"), "level"))
    known = levels[-1].select("key", "k", F.array(*map(F.lit, whole)).cast("array<long>").alias("before"))
    for level in levels[-2::-1]:
        known = step(lists(level).join(known, ["key", "k"]).mapInArrow(handed, "key string, k long, before array<long>"), "known")
    return known
