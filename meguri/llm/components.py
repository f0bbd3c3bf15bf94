"""Connected components of links, and links within shared buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meguri.llm.common import no_rows, step

RARE = 32  # members that hold an item, up to which it is rare
PARITY = 8  # words of 64 bits for each set in a join on items


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the component's
    smallest node.

    Distributed union-find by alternating stars: each node points its larger
    neighbours, then itself and its smaller neighbours, to the smallest one
    around. Every round is a grouping and a join, written to the shared folder;
    chains of length n end after about log n rounds. A node with very many
    neighbours is an aggregate and one row of the join's other side.
    """
    edges = step(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = step(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = step(small, "small")
        if _same(edges, small):
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of edges are equal, by count and a sum of hashes."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(mark(a)) == tuple(mark(b))


def shared_only(members: DataFrame) -> DataFrame:
    """Distinct (bucket, id) of the buckets that hold at least two different ids."""
    w = Window.partitionBy("bucket")
    return (
        members.withColumn("low", F.min("id").over(w)).withColumn("high", F.max("id").over(w))
        .filter("low < high").select("bucket", "id").distinct()
    )


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member beside the smallest and the largest id of its bucket, as distinct pairs a < b."""
    ends = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return (
        members.join(ends, "bucket").select("id", F.explode(F.array("low", "high")).alias("other")).filter("id <> other")
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    )


def both_buckets(members: DataFrame) -> DataFrame:
    """(bucket, id) for every two buckets that an id is in: who shares these is likelier to be
    linked than who shares one. An id is in few buckets."""
    own = members.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x, k: F.transform(F.slice("b", k + 2, F.size("b")), lambda y: F.xxhash64(x, y))))
    return own.select(F.explode(pairs).alias("bucket"), "id")


def bucket_links(members: DataFrame, linked: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Links (a, b) that join up the linked members of each bucket.

    ``linked`` returns those of the pairs (a, b) it is given that are links. A
    bucket is first compared with its smallest and largest member, and so is what two
    buckets share, so a bucket of m ids costs 2 m pairs and not m^2. In each further round, one member for each component
    within a bucket is compared with two others of these; a bucket within one component
    is done. Members that meet none of their neighbours as a centre stay apart.
    """
    stars = star_pairs(members).union(star_pairs(shared_only(both_buckets(members)))).distinct()
    links = step(linked(step(stars, "pairs")), "links")
    for k in range(rounds):
        roots = components(links)
        now = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        state = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
        now = step(now.join(state, "bucket"), "open")
        if no_rows(now):
            break
        heads = now.groupBy("bucket", "root").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), "id")).alias("m"))
        pairs = star_pairs(heads.select("bucket", F.col("m.id").alias("id")))
        links = step(links.union(linked(step(pairs, "pairs"))).distinct(), "links")
    return links


def folded(item: Column, words: int, gather: Callable[[Column], Column]) -> Column:
    """An aggregate: ``words`` numbers of 64 bits, with the bits that items are hashed to gathered by ``gather``."""
    spread = F.xxhash64(item, F.lit(1))
    word, bit = F.pmod(spread, F.lit(words)), F.shiftrightunsigned(spread, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return F.array(*[F.coalesce(gather(F.when(word == k, one)), F.lit(0).cast("long")) for k in range(words)])


def bits_apart(a: str, b: str, words: int) -> Column:
    """In how many bits two columns of ``folded`` differ: no more than the sets do in items."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(words)])


def prefix_pairs(members: DataFrame, held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) among which is every two linked ``members`` (id, root) of different roots.

    ``held`` has the (id, item) of their sets. The items of a set are placed from the rarest on,
    as counted among the members. Linked sets share at least p / (p + q) of both sizes, so
    the larger has a shared item among so many first places as may be missing from the other, and
    the smaller has it among fewer still; behind the first that they share, enough
    places must be left in both, and the parities of their items must allow a link.
    Items of one root alone meet nothing, but keep their places.
    """
    p, q = share
    held = held.join(members, "id")
    seen = held.groupBy("item").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    w = Window.partitionBy("id")
    placed = held.join(seen, "item").withColumn("size", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("n", "item")))
    long_part = F.col("size") - F.floor((p * F.col("size") + (q - 1)) / q) + 1
    short_part = F.col("size") - F.floor((2 * p * F.col("size") + (p + q - 1)) / (p + q)) + 1
    parity = held.groupBy("id").agg(folded(F.col("item"), PARITY, F.bit_xor).alias("parity"))
    keys = step(placed.filter("low < high").filter(F.col("place") <= long_part).join(parity, "id").select(
        "id", "root", "item", "size", "place", "parity", (F.col("place") <= short_part).alias("short")), "keys")
    a, b = (keys.select("item", "short", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "size", "place", "parity")]) for k in "ab")
    order = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("id_b") < F.col("id_a")))
    fits = q * F.col("size_b") >= p * F.col("size_a")
    left = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = (p + q) * left >= p * (F.col("size_a") + F.col("size_b"))
    apart = (p + q) * bits_apart("parity_a", "parity_b", PARITY) <= (q - p) * (F.col("size_a") + F.col("size_b"))
    met = a.drop("short").join(b.filter("short").drop("short"), "item").filter(order & fits & enough & apart & (F.col("root_a") != F.col("root_b")))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def all_bucket_links(members: DataFrame, held: Callable[[DataFrame], DataFrame], linked: Callable[[DataFrame], DataFrame], share: tuple[int, int], rounds: int = 1) -> DataFrame:
    """Links (a, b) that join up every two linked members of each bucket.

    What ``bucket_links`` leaves apart is compared with the plainest member of its bucket; then it meets by ``prefix_pairs``, whatever the buckets: members of
    one group by their rare items only, and what two groups have in common not at all. ``held`` gives
    the (id, item) of the sets of some (id); ``share`` is the least similarity, as a fraction.
    """
    found = step(bucket_links(members, linked, rounds), "found")
    apart = _apart(members, found)
    if no_rows(apart):
        return found
    items = step(held(apart.select("id").distinct()), "held")
    # the likeliest centre of a group is the member that has the fewest items for itself
    seen = items.groupBy("item").agg(F.count("*").alias("n"))
    rare = items.join(seen, "item").groupBy("id").agg(F.count(F.when(F.col("n") <= RARE, 1)).alias("rare"))
    heads = apart.join(rare, "id").groupBy("bucket").agg(F.min(F.struct("rare", "id", "root")).alias("head"))
    stars = apart.join(heads, "bucket").filter(F.col("root") != F.col("head.root"))
    stars = stars.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()
    found = step(found.union(linked(step(stars, "stars"))).distinct(), "found")
    apart = _apart(apart.select("bucket", "id"), found)
    if no_rows(apart):
        return found
    left = prefix_pairs(apart.select("id", "root").distinct(), items, share)
    return found.union(linked(step(left, "left")))


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, id, root) of the buckets whose members lie in several components of ``links``."""
    roots = components(links)
    now = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    state = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return step(now.join(state, "bucket").select("bucket", "id", "root"), "apart")
