"""Best-fit packing into sequences of several permitted lengths.

A text is as many tokens as its UTF-8 bytes, and one end mark (the byte-level
vocabulary). Texts longer than the longest sequence are cut into pieces. Pieces
are dealt at random to blocks of bounded size, each packed by one task that
holds lengths only: longest first, each piece into the open bin it fits
most tightly; where none has room, the permitted size with the least expected
cost per token is opened. That is done for every assortment of permitted sizes
to open, each bin is then downsized to the smallest size that holds its contents, and the
cheapest outcome is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import step, table
from meguri.llm.registry import query

SIZES = (2048, 4096, 8192, 16384)
QUADRATIC = 65536  # tokens at which attention costs as much as the rest
BLOCK = 50_000


def cost(size: float, quadratic: float = QUADRATIC) -> float:
    """Cost of one sequence: linear work and attention."""
    return size * (1 + size / quadratic)


def packed(lengths: list[int], openable: tuple[int, ...], quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """(bin of each length, size each bin was opened with); lengths come longest first."""
    bins: list[int] = []
    where: list[int] = []
    open_: dict[int, list[int]] = {}  # room -> bins with that room
    rooms: list[int] = []
    left, count, least = sum(lengths), len(lengths), lengths[-1] if lengths else 0
    for length in lengths:
        k = bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            at = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
        else:
            best = None
            for size in openable:
                if size >= length:
                    spare = size - length
                    waste = spare if spare < least else min(spare, left / count / 2)
                    used = min(size - waste, left)
                    rate = cost(size, quadratic) / used
                    if best is None or rate < best[0]:
                        best = (rate, size)
            room, at = best[1], len(bins)
            bins.append(room)
        where.append(at)
        room -= length
        if room >= least:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(at)
        left, count = left - length, count - 1
    return where, bins


def downsized(lengths: list[int], where: list[int], n: int, sizes: tuple[int, ...]) -> list[int]:
    """The smallest permitted size that holds each bin's contents."""
    full = np.bincount(where, weights=lengths, minlength=n).astype(np.int64)
    return [sizes[bisect_left(sizes, int(x))] for x in full]


def best_packing(lengths: list[int], sizes: tuple[int, ...], quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """(bin of each length, final size of each bin) of the cheapest assortment."""
    best = None
    top = sizes[-1]
    for n in range(len(sizes)):
        for some in combinations(sizes[:-1], n):
            where, bins = packed(lengths, (*some, top), quadratic)
            final = downsized(lengths, where, len(bins), sizes)
            total = sum(cost(s, quadratic) for s in final)
            if best is None or total < best[0]:
                best = (total, where, final)
    return best[1], best[2]


def token_count(text: Column) -> Column:
    """UTF-8 bytes and one end mark; null is the empty text."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, quadratic: float = QUADRATIC, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, start and length in tokens, bin,
    capacity of the bin and offset in it.

    Every row of ``docs`` is packed, repeated rows as often as they occur; a null
    or empty text is its end mark alone, a null id stays null. Equal lengths go in
    the order of their rows. Other columns are not read. No rows: no rows.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    rows = step(docs.select("doc_id", token_count(F.col("text")).alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    total = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    blocks = max(1, -(-total // block))
    pieces = rows.select(
        "doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece")
    ).select(
        "doc_id", "row", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("long").alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).alias("block"),
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = rows.column("length").to_pylist()
        where, final = best_packing(lengths, sizes, quadratic)
        filled, offsets = [0] * len(final), []
        for at, length in zip(where, lengths):
            offsets.append(filled[at])
            filled[at] += length
        first = (rows.column("block")[0].as_py() if len(lengths) else 0) << 32
        return pa.table({
            "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "start": rows.column("start"), "length": rows.column("length"),
            "bin": pa.array([first + at for at in where], pa.int64()), "capacity": pa.array([final[at] for at in where], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece long, start long, length long, bin long, capacity long, offset long")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
