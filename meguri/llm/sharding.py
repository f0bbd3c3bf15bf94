"""Shards by minimax contiguous partition.

Documents with equal texts form an atomic group; groups are ordered by a hash of
their text. The smallest shard capacity at which a greedy pass over the ordered
sizes needs no more than the wanted shards is found by binary search, and the
cuts are made there.

The driver never sees single groups. It sees units: ranges of the hash order
that hold whole groups, refined until each is at most 1/1024 of a mean shard, or
one group. How many there are depends on the shard count alone. The capacity is
the least for these units, so at most that share above the least for groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import numbered, step, table
from meguri.llm.registry import query

LAW = "bytes"
FINE = 1024


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity at which greedy filling in order needs at most ``shards``."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)

    def needed(capacity: int) -> int:
        at, used = 0, 0
        while at < len(ends) and used <= shards:
            at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, side="right"))
            used += 1
        return used

    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First unit of each shard: every shard within the smallest capacity, and,
    within that, as near to an equal share of what is left as the order allows."""
    n = len(sizes)
    if not n:
        return [0] * shards
    ends = np.concatenate([[0], np.cumsum(sizes)])
    capacity = smallest_capacity(sizes, shards)
    # the earliest start from which the remaining shards still suffice
    late = [n] * (shards + 1)
    for k in range(shards - 1, 0, -1):
        late[k] = int(np.searchsorted(ends, ends[late[k + 1]] - capacity, side="left"))
    out = [0]
    for k in range(1, shards):
        start = out[-1]
        most = int(np.searchsorted(ends, ends[start] + capacity, side="right")) - 1
        aim = ends[start] + (ends[n] - ends[start]) / (shards - k + 1)
        near = int(np.searchsorted(ends, aim, side="left"))
        if near > start + 1 and aim - ends[near - 1] < ends[min(near, n)] - aim:
            near -= 1
        out.append(max(start, late[k], min(near, most)))
    return out


def _unsigned(h: Column, bits: int, done: int) -> Column:
    """The next ``bits`` bits of a hash after the first ``done``."""
    return F.shiftrightunsigned(F.shiftleft(h, done), 64 - bits)


def units(groups: DataFrame, shards: int, total: int) -> list[tuple[int, int, int]]:
    """(first hash, as unsigned; bytes; groups) of each unit in order.

    Units that are too large and hold several groups are split by further bits,
    all of one round in one job over the narrow table of groups.
    """
    most = max(1, total // (shards * FINE))
    bits = (2 * shards * FINE - 1).bit_length()
    h = F.col("h")
    done, parents, out = 0, None, []
    while done < 64:
        bits = min(bits, 64 - done)
        rows = groups
        if parents is not None:
            rows = rows.join(F.broadcast(parents), _unsigned(h, done, 0) == F.col("parent"), "left_semi")
        got = rows.groupBy(_unsigned(h, done + bits, 0).alias("unit")).agg(
            F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n")).collect()
        done += bits
        large = [r for r in got if r["bytes"] > most and r["n"] > 1 and done < 64]
        names = {r["unit"] for r in large}
        out += [((r["unit"] << (64 - done)) & (2**64 - 1), r["bytes"], r["n"]) for r in got if r["unit"] not in names]
        if not large:
            break
        parents = groups.sparkSession.createDataFrame([(r["unit"],) for r in large], "parent long")
        bits = 8
    return sorted(out)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16; null counts as the empty text and
    shares its group. Rows with equal texts share a shard, repeated rows each
    keep a row and a slot, and a tie in order is broken by the id, nulls first.
    Slots run from 0 without a gap in the order of (text hash, id). No rows: no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    # the order is by unsigned hash; flipping the sign bit makes the signed order equal to it
    rows = step(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
    ), "sizes")
    groups = step(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    found = units(groups, shards, total)
    starts = [found[k][0] if k < len(found) else None for k in cuts(np.array([b for _, b, _ in found], dtype=np.int64), shards)]
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    shard = F.lit(0)
    for k, start in enumerate(starts[1:], 1):
        if start is not None:
            shard = F.when(order >= F.lit(_signed(start ^ 2**63)), k).otherwise(shard)
    ordered = rows.withColumn("shard", shard.cast("int")).withColumn("order", order)
    return numbered(ordered, "shard", ["order", "doc_id", "row"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


@query("op4_minimax_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return assign(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
