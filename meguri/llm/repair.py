"""Repair of conversations whose messages are blank, repeated, cut off or out of turn.

A repaired conversation is empty, or an optional system message and then user and
assistant in turns. The cheapest edits that make it so are a shortest path over
(messages read, state), found by the auction algorithm; see ``auction``.

A conversation may have any number of messages: they are numbered in their order by
Spark and cut into blocks of BLOCK. A block's costs from state to state are put together
over the blocks after it (``scans``), which gives the cost of leaving it in each state; with
these its own path is found from each state, and the blocks before it tell in which one it begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm import auction
from meguri.llm.common import numbered, step, table
from meguri.llm.registry import query
from meguri.llm.scans import exclusive

BLOCK = 256  # messages
_BLANKS = " \t\n\x0b\x0c\r"
_STATES = range(auction.STATES)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def _key(value: Column) -> Column:
    """A text for each id, for null too."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def messages(conversations: DataFrame) -> DataFrame:
    """key, row, copy, turn, role and text of each message as it is; a null role or text is one space."""
    return conversations.select(
        _key(F.col("conv_id")).alias("key"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("copy"), "turn",
        _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The same after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the message,
    1 empties it, 2 takes its full stops, 3 repeats it behind itself, 4 makes it the user's."""
    kind = F.pmod(F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn")))), F.lit(20))
    said = conversations.select(
        _key(F.col("conv_id")).alias("key"), F.monotonically_increasing_id().alias("row"), "turn",
        _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return said.filter("kind <> 0").select(
        "key", "row", F.explode(copies).alias("copy"), "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def judged(said: DataFrame) -> DataFrame:
    """key, place, row, copy, turn, initial (s, u, a, or - for any other) and fault (b blank,
    d seen before, t cut off, or a dot) of each message. Places count from 0 by turn,
    null turns first, then by row."""
    initial = F.left("role", F.lit(1))
    rest = F.rtrim(F.col("text"), F.lit(_BLANKS))
    mark = F.md5(F.concat(F.length("key"), F.lit(":"), "key", F.length("role"), F.lit(":"), "role", "text"))
    light = said.select(
        "key", "turn", "row", "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
        F.when(rest == "", "b").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".").alias("fault"), mark.alias("mark"))
    placed = step(numbered(light, "key", ["key", "turn", "row", "copy"], "place"), "placed")
    first = placed.groupBy("mark").agg(F.min("place").alias("first"))
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault"))
    return placed.join(first, "mark").select("key", "place", "row", "copy", "turn", "initial", fault.alias("fault"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """key, k, initials and faults (a letter a message), last, and ids (row, copy) of each block."""
    k = F.floor(F.col("place") / BLOCK).cast("long")
    listed = rows.groupBy("key", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct("place", "initial", "fault", "row", "copy"))).alias("m"))  # at most BLOCK
    letters = lambda c: F.array_join(F.transform("m", lambda x: x[c]), "")
    found = listed.select("key", "k", letters("initial").alias("initials"), letters("fault").alias("faults"),
                          F.transform("m", lambda x: F.struct(x["row"].alias("row"), x["copy"].alias("copy"))).alias("ids"))
    ends = rows.groupBy("key").agg(F.floor(F.max("place") / BLOCK).cast("long").alias("last"))
    return found.join(ends, "key").withColumn("last", F.col("k") == F.col("last"))


def _cheaper(a: list[int], b: list[int]) -> list[int]:
    """Least sums over the state between two tables of costs."""
    n = auction.STATES
    return [min(auction.NEVER, min(a[q * n + m] + b[m * n + to] for m in _STATES)) for q in _STATES for to in _STATES]


def _then(a: list[int], b: list[int]) -> list[int]:
    """The state after both; -1 where there is no way."""
    return [b[q] if q >= 0 else -1 for q in a]


def _costs(blocks: DataFrame) -> DataFrame:
    """(key, k, value): each block's costs from state to state; of a last block, of ending, whatever the second state."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = []
            for initials, faults, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "last"))):
                if last:
                    out.append([c for c in auction.solved(initials, faults, None)[0] for _ in _STATES])
                else:
                    out.append(list(auction.through(initials, faults)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(out, pa.list_(pa.int64()))], names=["key", "k", "value"])

    return blocks.select("key", "k", "initials", "faults", "last").mapInArrow(run, "key string, k long, value array<long>")


def _ways(blocks: DataFrame) -> DataFrame:
    """Adds costs, marks and value (state after) from each state to ``blocks`` with leave."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = []
            for initials, faults, leave in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "leave"))):
                out.append(auction.solved(initials, faults, leave and tuple(leave)))
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([list(c) for c, _ in out], pa.list_(pa.int64())),
                pa.array([[w[0] if w else None for w in ways] for _, ways in out], pa.list_(pa.string())),
                pa.array([[w[1] if w else -1 for w in ways] for _, ways in out], pa.list_(pa.int64())),
            ], names=[*batch.schema.names, "costs", "marks", "value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{schema}, costs array<long>, marks array<string>, value array<long>")


def paths(blocks: DataFrame) -> DataFrame:
    """``blocks`` with state (before it), cost (from there to the conversation's end) and audit (initials of its edits)."""
    none = F.lit(None).cast("array<long>")
    single, many = blocks.filter("last and k = 0"), blocks.filter("not last or k > 0")
    if not many.isEmpty():
        neutral = [0 if q == to else auction.NEVER for q in _STATES for to in _STATES]
        after = exclusive(_costs(many), _cheaper, neutral, reverse=True)
        leave = F.transform(F.sequence(F.lit(0), F.lit(auction.STATES - 1)), lambda q: F.col("before")[q * auction.STATES])
        many = many.join(after, ["key", "k"]).withColumn("leave", F.when(F.col("last"), none).otherwise(leave)).drop("before")
        many = step(_ways(many), "ways")
        states = exclusive(many.select("key", "k", "value"), _then, list(_STATES))
        many = many.join(states.select("key", "k", F.col("before")[0].alias("state")), ["key", "k"])
        found = _ways(single.withColumn("leave", none)).withColumn("state", F.lit(0).cast("long")).unionByName(many)
    else:
        found = _ways(single.withColumn("leave", none)).withColumn("state", F.lit(0).cast("long"))
    at = F.col("state").cast("int")
    return found.select("key", "k", "initials", "faults", "ids", "state", F.col("costs")[at].alias("cost"), F.col("marks")[at].alias("audit"))


def edits(found: DataFrame) -> DataFrame:
    """key, at (in order), row, copy, put (lines inserted before it), kept (whether the
    message stays) and role (what it becomes, if anything) of each message, and what is put in at a block's end."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out: dict[str, list] = {c: [] for c in ("key", "at", "row", "copy", "put", "kept", "role")}
            for key, k, initials, ids, state, audit in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "initials", "ids", "state", "audit"))):
                for i, (put, mark, role) in enumerate(auction.roles(audit, initials, state)):
                    if put or mark in "KR" and mark:
                        own = ids[i] if mark else {"row": None, "copy": None}
                        for c, v in zip(out, (key, k * (BLOCK + 1) + i, own["row"], own["copy"], [f"{r}:" for r in put], mark in "KR" and bool(mark), role or None)):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["key"], pa.string()), pa.array(out["at"], pa.int64()), pa.array(out["row"], pa.int64()), pa.array(out["copy"], pa.int32()),
                pa.array(out["put"], pa.list_(pa.string())), pa.array(out["kept"], pa.bool_()), pa.array(out["role"], pa.string())], names=list(out))

    return found.select("key", "k", "initials", "ids", "state", "audit").mapInArrow(
        run, "key string, at long, row long, copy int, put array<string>, kept boolean, role string")


def lines_of(said: DataFrame, found: DataFrame) -> DataFrame:
    """key, at and line: ``role:text`` of each repaired message."""
    own = said.select("row", "copy", F.col("role").alias("_role"), "text")
    line = F.concat(F.coalesce("role", "_role"), F.lit(":"), F.col("text"))
    joined = edits(found).join(own, ["row", "copy"], "left")
    all_lines = F.concat("put", F.when(F.col("kept"), F.array(line)).otherwise(F.array().cast("array<string>")))
    return joined.select("key", "at", F.array_join(all_lines, "\n").alias("line"))


def digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256). A digest has to read its conversation in order: rows are
    sorted within the partition and hashed as a stream, nothing is gathered."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in frames:
            done = []
            for now, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["key", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    return lines.repartition("key").sortWithinPartitions("key", "at").select("key", "line").mapInArrow(run, "key string, repaired_sha256 string")


def counts_of(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated and illegal."""
    fault = lambda c: F.count(F.when(F.col("fault") == c, 1))
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    plain = rows.groupBy("key").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), fault("b").alias("blank"), fault("d").alias("duplicate"), fault("t").alias("truncated"))
    ends = blocks.select("key", (F.col("k") + 1).alias("k"), F.right("initials", F.lit(1)).alias("before"))
    whole = blocks.select("key", "k", "initials").join(ends, ["key", "k"], "left").select("key", F.concat(F.coalesce("before", F.lit("")), "initials").alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.col("s").substr(i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    return plain.join(whole.groupBy("key").agg(F.sum(wrong).alias("illegal")), "key")


def repaired(conversations: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation of ``conversations``, from its messages ``said``.

    The first fault of a message counts: blank, then equal role and text seen before
    in its conversation, then not ending in a full stop, exclamation or question mark.
    Messages are ordered by turn, nulls first; equal turns, as of repeated rows, by their place in the input,
    which must be the same whenever it is read, as of files and written steps. A null
    conv_id is a conversation; null roles and texts are one space. Conversations without
    messages: zeros, an empty audit and the digest of nothing. Long texts are
    only read by the digests, as streams. Other columns are not read. No rows: no rows.
    """
    rows = step(judged(said), "judged")
    blocks = step(blocks_of(rows), "blocks")
    found = step(paths(blocks), "paths")
    whole = found.groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "audit"))), lambda x: x["audit"]), "").alias("audit"),  # a letter a message, as asked for
        F.min(F.when(F.col("k") == 0, F.col("cost"))).alias("cost"))
    keys = conversations.select("conv_id", _key(F.col("conv_id")).alias("key")).distinct()
    out = keys.join(counts_of(rows, blocks), "key", "left").join(whole, "key", "left").join(digests(lines_of(said, found)), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_lines(said: DataFrame) -> DataFrame:
    """key, at and line: the repaired conversations themselves, in order by (key, at)."""
    return lines_of(said, step(paths(step(blocks_of(judged(said)), "blocks")), "paths"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repaired(conversations, damaged(conversations))
