"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are trimmed; blank lines take no part. A line's set is all its distinct
shingles of 9 characters; a shorter line is its own shingle. Two lines are
near duplicates when the Jaccard similarity of their sets is 0.8 or more. Equal
lines are brought together first. 21 minima over all shingles make 7 bands of 3; lines that share a band are verified on
their whole sets; distributed union-find makes the components, and each keeps the first of its occurrences by (doc_id, row, line).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import maybe, only_where, step, table
from meguri.llm.components import all_bucket_links, bits_apart, components, folded, shared_only
from meguri.llm.registry import query

SHINGLE = 9
PIECE = 32  # shingles taken from a stretch: finding a place in a text takes time as long as the text
SHARE = (80, 100)
BANDS, ROWS = 7, 3
CROWD = 16  # lines in a bucket up to which all its pairs are verified; of larger ones, those that bounds allow
BITS = 16  # words of 64 bits for each line
_BLANKS = " \t\r\x0b\x0c"


def trimmed(line: Column) -> Column:
    """Without blanks at either end. Spark's trim of a set of characters is slow,
    so it is left to lines that have more than spaces there."""
    plain = F.trim(line)
    odd = [test(F.lit(c)) for c in _BLANKS[1:] for test in (plain.startswith, plain.endswith)]
    return F.when(reduce(lambda x, y: x | y, odd), F.btrim(line, F.lit(_BLANKS))).otherwise(plain)


def occurrences(docs: DataFrame) -> DataFrame:
    """row, doc_id, line (its place in the text) and id (hash of the trimmed
    line) of each line that isn't blank.

    ``docs`` must give its rows in the same order whenever it is read, as files
    and written steps do: rows are told apart by their place.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("said", trimmed(F.col("said"))).filter("said <> ''").select("row", "doc_id", "line", F.xxhash64("said").alias("id"))


def _turned(h: Column, by: int) -> Column:
    return h if by == 0 else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _said(docs: DataFrame) -> DataFrame:
    """(id, said) of every line that isn't blank."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("said")).select(trimmed(F.col("said")).alias("said"))
    return lines.filter("said <> ''").select(F.xxhash64("said").alias("id"), "said")


def _pieces(said: Column) -> Column:
    """Stretches of a line, overlapping so that each of its shingles begins in just one."""
    pieces = F.regexp_extract_all(said, F.lit(f"(?s)(?=(.{{{SHINGLE},{PIECE + SHINGLE - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.when(F.length(said) < SHINGLE, F.array(said)).otherwise(pieces)


def _places(piece: Column) -> Column:
    """Where the shingles of a stretch begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.length(piece) - (SHINGLE - 1), F.lit(1)))


def _hashed(lines: DataFrame, text: str) -> DataFrame:
    """(id, h) of every shingle of each line; they may repeat.

    Characters are found by walking a text, bytes at once: stretches whose characters are single
    bytes are cut as bytes, which have the hash of the text they are.
    """
    pieces = lines.select("id", F.explode(_pieces(F.col(text))).alias("piece"))
    single = F.when(F.octet_length("piece") == F.length("piece"), F.col("piece").cast("binary"))
    placed = pieces.withColumn("raw", single).select("id", "piece", "raw", F.explode(_places(F.col("piece"))).alias("at"))
    of = lambda c: F.xxhash64(F.col(c).substr(F.col("at"), F.lit(SHINGLE)))
    return placed.select("id", F.when(F.col("raw").isNotNull(), of("raw")).otherwise(of("piece")).alias("h"))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, bands) of each distinct line, from all its shingles.

    Lines are brought together by id, which is the one shuffle of texts; the
    shingles of a line stay in its partition, so the minima need no other.
    """
    lines = _said(docs).groupBy("id").agg(F.first("said").alias("said"))
    hashed = _hashed(lines, "said")
    bases = ROWS
    hashed = hashed.select("id", *[F.xxhash64("h", F.lit(i)).alias(f"h{i}") for i in range(bases)])
    turns = BANDS * ROWS // bases
    least = [F.min(_turned(F.col(f"h{i}"), 64 // turns * t)).alias(f"m{i}_{t}") for i in range(bases) for t in range(turns)]
    names = [f"m{k % bases}_{k // bases}" for k in range(BANDS * ROWS)]  # a band's minima are of different bases
    bands = F.array(*[F.xxhash64(F.lit(b), *names[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    return hashed.groupBy("id").agg(*least).select("id", bands.alias("bands"))


def _shingles(said: Column) -> Column:
    """Hashes of a line's shingles; they may repeat."""
    of = lambda piece: F.transform(_places(piece), lambda at: F.xxhash64(piece.substr(at, F.lit(SHINGLE))))
    return F.flatten(F.transform(_pieces(said), of))


def lines_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the lines in ``wanted`` (id)."""
    return maybe(_said(docs), wanted).groupBy("id").agg(F.first("said").alias("line")).join(wanted, "id", "left_semi")


def with_bits(lines: DataFrame) -> DataFrame:
    """(id, most, bits) for (id, line): the number of its shingles with repeats, and the bits that they are hashed to."""
    hashed = _hashed(lines, "line")
    return hashed.groupBy("id").agg(F.count("*").alias("most"), folded(F.col("h"), BITS, F.bit_or).alias("bits"))


def _could_be(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs that the bits allow: sets differ in at least as many shingles as in
    bits, and linked ones in at most (q - p) / (q + p) of both sizes."""
    p, q = SHARE
    for k in "ab":
        pairs = pairs.join(lines.select(F.col("id").alias(k), F.col("most").alias(f"most_{k}"), F.col("bits").alias(f"bits_{k}")), k)
    return pairs.filter((q + p) * bits_apart("bits_a", "bits_b", BITS) <= (q - p) * (F.col("most_a") + F.col("most_b"))).select("a", "b")


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs (a, b) of line ids whose sets reach the similarity; ``lines`` has id, line, most and bits.

    Bounds rule most pairs out before texts are joined. Hashes take eight times the room
    of their text, so it is the texts that are shuffled.
    """
    p, q = SHARE
    pairs = _could_be(pairs, lines)
    for k in "ab":
        pairs = pairs.join(lines.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")), k)
    sets = pairs.select("a", "b", _shingles(F.col("line_a")).alias("x"), _shingles(F.col("line_b")).alias("y"))
    counts = only_where(sets, F.size("x") >= 0).select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), F.size(F.array_union("x", "y")).alias("whole"))
    return only_where(counts, q * F.col("same") >= p * F.col("whole")).select("a", "b")


def links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between ids of different lines."""
    signed = signatures(docs)
    shared = step(shared_only(signed.select(F.explode("bands").alias("bucket"), "id")), "shared")
    lines = step(lines_of(docs, step(shared.select("id").distinct(), "wanted")), "lines")
    known = step(lines.join(with_bits(lines), "id"), "candidates")
    counts = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    few = shared.join(counts.filter(F.col("n") <= CROWD), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    all_pairs = F.transform("ids", lambda x, k: F.transform(F.slice("ids", k + 2, F.lit(CROWD)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    plain = step(few.select(F.explode(F.flatten(all_pairs)).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    crowded = step(shared.join(counts.filter(F.col("n") > CROWD).select("bucket"), "bucket"), "crowded")
    verify = lambda pairs: similar(pairs, known)
    held = lambda ids: known.join(ids, "id", "left_semi").select("id", F.explode(F.array_distinct(_shingles(F.col("line")))).alias("item"))
    return verify(plain).union(all_bucket_links(crowded, held, verify, SHARE))


def dropped(docs: DataFrame) -> DataFrame:
    """row, doc_id, line, id and component of every line occurrence, and whether it goes.

    One occurrence of each component stays: the first by (doc_id, row, line),
    null ids first. Null and empty texts have no lines. Repeated rows are rows of
    their own: the lines of all but the first go. Lines are compared whole, however
    long. Other columns are not read. No rows: no rows.
    """
    roots = components(step(links(docs), "all"))
    said = step(occurrences(docs), "occurrences")
    ids = said.groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"))
    ids = ids.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("component", F.coalesce("root", "id"))
    firsts = ids.groupBy("component").agg(F.min("first").alias("first"))
    known = step(ids.select("id", "component").join(firsts, "component").select("id", "component", F.col("first.row").alias("keep_row"), F.col("first.line").alias("keep_line")), "firsts")
    return said.join(known, "id").select(
        "row", "doc_id", "line", "id", "component", ((F.col("row") != F.col("keep_row")) | (F.col("line") != F.col("keep_line"))).alias("goes")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; columns, whatever their names, and other lines as they were.

    A document that had words and lost all its lines goes; one that had none stays:
    null, empty and blank texts come back as they were. Lines of any length are compared
    whole. No rows: no rows.
    """
    gone = dropped(docs).filter("goes").groupBy("row").agg(F.collect_list("line").alias("gone"))  # at most a text's lines
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    lines = F.split("doc.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    out = rows.join(gone, "row", "left").select("doc", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(text).alias("new"), "gone")
    out = out.filter(F.col("gone").isNull() | (F.btrim("new", F.lit(" \t\r\n\x0b\x0c")) != ""))
    return out.select(*[F.col("new").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


@query("op9_fuzzy_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its lines, how many of them go, and a digest of the places of these."""
    docs = table(spark, folder, "documents")
    lines = dropped(docs).groupBy("row").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("goes"), 1)).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("line")))).alias("gone"),
    )
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"))
    zero = F.lit(0).cast("long")
    return rows.join(lines, "row", "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_dropped", zero).alias("n_dropped"),
        F.concat_ws(",", F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda i: i.cast("string"))).alias("dropped_lines"),
    )
