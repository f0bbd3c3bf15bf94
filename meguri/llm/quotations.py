"""Reply structure of conversations from quoted passages.

Lines that begin with > are quoted, nested as often as the sign stands there.
Each run of one depth is a passage; it is normalised (blanks, case, outer
punctuation), hashed as a whole, by paragraph and by line, and joined to the
first earlier message of its conversation that says the same in its own words.
A message answers the original of its shallowest linked passage. Conversations
come out without quotes, thread by thread, each message after the one it answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, no_rows, numbered, step, table
from meguri.llm.registry import query

_MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# How mail programs introduce a quotation.
_INTRO = re.compile(r"(?:wrote|schrieb|escribió|a écrit)[^\n]{0,80}:[ \t]*\Z|\A-{2,}[ \t]*original message[ \t]*-{2,}\Z", re.I)
_INTRO_HEAD = re.compile(r"(?:on|am|el|le)\b[^.!?]*\Z", re.I)
_GAP = re.compile(r"\n(?:[ \t]*\n)+")


def leveled(text: str) -> list[tuple[int, str]]:
    """(depth, content) of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(passage: str) -> str:
    """Lower case, single blanks, without outer punctuation."""
    return " ".join(passage.lower().split()).strip(" .,;:!?…\"'()[]-")


def _hash(passage: str) -> int | None:
    form = normal(passage)
    return xxhash.xxh64_intdigest(form) - 2**63 if form else None


def units(passage: str) -> list[int]:
    """Hashes of a passage: as a whole, by paragraph, by line; each once."""
    parts = [passage, *_GAP.split(passage), *passage.split("\n")]
    return list(dict.fromkeys(h for p in parts if (h := _hash(p)) is not None))


def parsed(text: str) -> tuple[str, list[dict]]:
    """(text without quotes and their introductions, quoted passages in order)."""
    lines = leveled(text)
    if not any(level for level, _ in lines):
        return text, []
    own, quotes = [], []
    at = 0
    while at < len(lines):
        level, end = lines[at][0], at
        while end < len(lines) and lines[end][0] == level:
            end += 1
        run = [content for _, content in lines[at:end]]
        if end < len(lines) and lines[end][0] > level:  # the run introduces a deeper quote
            while run and not run[-1].strip():
                run.pop()
            if run and _INTRO.search(run[-1].strip()):
                last = run.pop()
                if run and not _INTRO_HEAD.match(last.strip()) and _INTRO_HEAD.match(run[-1].strip()):
                    run.pop()
        if level == 0:
            own.append("\n".join(run))
        else:
            passage = "\n".join(run)
            found = units(passage)
            if found:
                quotes.append({"number": len(quotes), "level": level, "first_line": at, "last_line": end - 1, "units": found})
        at = end
    kept = "\n".join(own)
    return _GAP.sub("\n\n", kept).strip("\n"), quotes


_QUOTES = "array<struct<number:int,level:int,first_line:int,last_line:int,units:array<bigint>>>"


def messages(conversations: DataFrame) -> DataFrame:
    """row, conv_id, turn, role, text without quotes, hashes of its own passages, quoted passages."""
    quote = pa.list_(pa.struct([
        ("number", pa.int32()), ("level", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("units", pa.list_(pa.int64())),
    ]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = [(None, []) if t is None else parsed(t) for t in batch.column("_text").to_pylist()]
            own = [[] if t is None else units(t) for t, _ in found]
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([t for t, _ in found], pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array([q for _, q in found], quote)],
                names=[*kept.schema.names, "text", "own", "quotes"],
            )

    rows = conversations.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", F.col("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, f"{schema}, text string, own array<bigint>, quotes {_QUOTES}")


def links(said: DataFrame) -> DataFrame:
    """row, number and level of each quoted passage that has an original, and
    the original's row and turn: that of its most inclusive unit that has one."""
    quoted = said.filter("conv_id is not null and turn is not null").select("row", "conv_id", "turn", F.explode("quotes").alias("q")).select(
        "row", "conv_id", "turn", "q.number", "q.level", F.posexplode("q.units").alias("place", "unit"))
    originals = (
        said.filter("conv_id is not null and turn is not null").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", "row", F.explode("own").alias("unit"))
        .groupBy("conv_id", "unit").agg(F.min(F.struct("turn", "row")).alias("first"))  # one row for a passage, however often said
    )
    return (
        quoted.join(originals, ["conv_id", "unit"]).filter(F.col("first.turn") < F.col("turn"))
        .groupBy("row", "number", "level").agg(F.min(F.struct("place", "first")).alias("best"))
        .select("row", "number", "level", F.col("best.first.row").alias("original_row"), F.col("best.first.turn").alias("original_turn"))
    )


def threads(parents: DataFrame) -> DataFrame:
    """(row, root, depth) of every row in ``parents`` (row, parent); by doubling, so a chain
    of length n takes about log n rounds."""
    tops = parents.select(F.col("parent").alias("row")).join(parents, "row", "left_anti").distinct()
    state = step(
        parents.select("row", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
        .union(tops.select("row", F.col("row").alias("up"), F.lit(0).cast("long").alias("depth"))), "threads")
    while True:
        above = state.select(F.col("row").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        after = step(state.join(above, "up").select("row", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "threads")
        if no_rows(after.filter("depth > 0").join(state.select("row", F.col("depth").alias("was")), "row").filter("depth <> was")):
            return after.select("row", F.col("up").alias("root"), "depth")
        state = after


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, reply_to
    (turn of the message it answers), thread (turn of the first message of its thread),
    depth, n_quotes, n_linked, and position in the conversation, from 0.

    Messages are ordered by thread, then turn, then row; an answer has a later
    turn than what it answers. A message without a linked quote starts a thread.
    Null text stays null and is quoted by nobody; a null conversation or turn has
    no links, and messages of null conversations are numbered together. Repeated
    rows and equal turns keep all their rows; the first of them counts as the original. Other columns are
    not read. No rows: no rows.
    """
    said = step(messages(conversations), "messages")
    found = step(links(said), "links")
    per_row = found.groupBy("row").agg(
        F.min(F.struct("level", "number", "original_row", "original_turn")).alias("best"), F.count("*").alias("n_linked"))
    answers = per_row.select("row", F.col("best.original_row").alias("parent"), F.col("best.original_turn").alias("reply_to"), "n_linked")
    roots = threads(step(answers.select("row", "parent"), "parents"))
    turns = said.select(F.col("row").alias("root"), F.col("turn").alias("thread"))
    placed = (
        said.select("row", "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"))
        .join(answers.select("row", "reply_to", "n_linked"), "row", "left")
        .join(roots.join(turns, "root").select("row", "thread", "depth"), "row", "left")
        .withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
        .withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    )
    return numbered(placed, "conv_id", ["conv_id", "thread", "turn", "row"], "position").drop("row")


def formatted(ordered: DataFrame, start: str = "<|{role}|>\n", end: str = "<|end|>\n") -> DataFrame:
    """Adds ``chat``: each message in its frame; by position they make up the
    conversation. A null role is ``user``, a null text is empty."""
    head, tail = start.split("{role}")
    return ordered.withColumn("chat", F.concat(F.lit(head), F.coalesce("role", F.lit("user")), F.lit(tail), F.coalesce("text", F.lit("")), F.lit(end)))


@query("op1_quotation_threads")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return formatted(reply_ordered(table(spark, folder, "conversations")))
