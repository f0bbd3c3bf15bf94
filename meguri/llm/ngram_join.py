"""Near duplicates by Jaccard similarity of word shingles, joined on PartEnum signatures.

A set of 5-word shingles is held as 64-bit hashes. Sizes are cut into bands so
that sets of similarity 0.8 or more lie in the same or in neighbouring bands.
For the band of the smaller set, at most k shingles differ between two such
sets; the domain of shingles is cut into n > k partitions, so at least n - k
partitions have no difference. Each non-empty partition of a set gives one
signature: band, partition and the shingles in it. Two sets with such a
similarity therefore share a signature whenever one of them has more than k that are
non-empty. Of these a set gives some more than k, the least by their hash, which
are enough to share one. Small sets may have no more than k; these scant sets also meet one another on
their single shingles.

A set may leave out signatures as long as more than k remain. Those in crowded
buckets are left out where the set can afford it. Sets that cannot, as in a large
group of near copies, are hard; only pairs of two hard sets need more. Such a
pair either shares a shingle that is rare among hard sets, and is found by it, or
differs in all its rare shingles and, in each of 32 groups of the common ones, at least
in the difference of its numbers. That bound rules out most pairs by counts alone; the rest are joined up by
comparing each bucket with its member of fewest rare shingles, and then members
of different components that the bound still allows. So no link between components
is lost, and no bucket is compared in all its pairs. Candidates are verified on
their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meguri.llm.common import batches, maybe, mixed, no_rows, step, table, texts_of, word_codes
from meguri.llm.components import all_bucket_links, bits_apart, components, shared_only
from meguri.llm.registry import query

WIDTH = 5
SHARE = (80, 100)  # the least similarity, as a fraction
GROUPS = 32  # of common shingles, by hash
CROWD = 32  # ids in a bucket above which it is crowded
PARITY = 16  # words of 64 bits for each set: the parities of its shingles by hash
MARK = 40  # bits of a signature's hash
SENT = 2_000_000  # hashes that may be sent to every task; more are joined

_STEP = np.uint64(0x9E3779B97F4A7C15)


# -- sets ---------------------------------------------------------------------
def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(start of each text's set, its distinct shingle hashes)."""
    # lower() of bytes changes A-Z only; split() knows exactly the six blanks
    starts, codes, unique = word_codes([t.encode("utf-8", "surrogatepass").lower().split() for t in texts])
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), dtype=np.uint64, count=len(unique))
    word = hashed[codes] if len(unique) else np.zeros(0, dtype=np.uint64)
    sizes = np.diff(starts)
    out = word.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):  # whatever follows the text is cut off below
            following = np.concatenate([word[k:], np.zeros(min(k, len(word)), dtype=np.uint64)])
            out = mixed(out) * _STEP + following
        out = mixed(out)
        count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
        for i in np.flatnonzero((sizes > 0) & (sizes < width)):  # the whole sequence as one
            h = np.uint64(sizes[i])
            for w in word[starts[i] : starts[i + 1]]:
                h = mixed(np.array([h * _STEP + w]))[0]
            out[starts[i]] = h
        owner = np.repeat(np.arange(len(sizes)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[:-1], count)
        values = out[at]
        own = values + mixed(owner.astype(np.uint64) * _STEP)  # equal within a text where the values are
    order = np.argsort(own)
    again = order[1:][own[order[1:]] == own[order[:-1]]]
    new = np.ones(len(values), dtype=bool)
    new[again] = False
    owner, values = owner[new], values[new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]), values


def set_keys(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for an empty one."""
    sizes = np.diff(starts)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = mixed(np.add.reduceat(mixed(values ^ _STEP), starts[some]) + sizes[some].astype(np.uint64) * _STEP)
            out[some] = np.where(out[some] == 0, 1, out[some])
    return out.view(np.int64)


def parities(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """PARITY numbers a set: for each of their bits, whether an odd number of its shingles is hashed to it."""
    sizes, places = np.diff(starts), np.uint64(64 * PARITY)
    at = np.repeat(np.arange(len(sizes)), sizes) * int(places) + (mixed(values ^ np.uint64(0xC2B2AE3D27D4EB4F)) % places).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sizes) * int(places)) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sizes), PARITY)


# -- signatures ---------------------------------------------------------------
class Bands:
    """Size bands, and for each the greatest difference and the partitions."""

    def __init__(self, share: tuple[int, int] = SHARE, spare: float = 0.35, least_spare: int = 3, largest: int = 1 << 40):
        p, q = share
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, tops[-1] * q // p))
        self.tops = np.array(tops, dtype=np.int64)
        # |A| <= top, |B| <= |A| q / p, and a difference is at most (|A| + |B|) (q - p) / (q + p)
        self.differ = np.array([(t + t * q // p) * (q - p) // (q + p) for t in tops], dtype=np.int64)
        self.parts = np.where(self.differ == 0, 1, self.differ + 1 + np.maximum(least_spare, np.ceil(spare * self.differ)).astype(np.int64))
        # signatures that a set gives beyond k + 1, if it has them
        self.more = np.maximum(least_spare, -(-self.differ // 8))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes, side="left")


def _slots(starts: np.ndarray, values: np.ndarray, bands: Bands, lower: int) -> tuple[np.ndarray, ...]:
    """(band of each set, first slot of each set, slot of each shingle): a slot is a partition of one set."""
    sizes = np.diff(starts)
    band = np.maximum(bands.band(sizes) - lower, 0)
    n = bands.parts[band]
    first = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n, 0))])
    part = mixed(values + np.uint64(0x9FB21C651E98DF25)) % np.repeat(n, sizes).astype(np.uint64)
    return band, first, np.repeat(first[:-1], sizes) + part.astype(np.int64)


def spares(starts: np.ndarray, values: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """How many of the signatures it gives each set can leave out in its own band and in
    the one below: those beyond k + 1; may be negative."""
    out = []
    for lower in (0, 1):
        band, first, slot = _slots(starts, values, bands, lower)
        filled = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=int(first[-1])) > 0)])
        out.append(np.minimum(filled[first[1:]] - filled[first[:-1]] - bands.differ[band] - 1, bands.more[band]))
    return out[0], out[1]


def signatures(starts: np.ndarray, values: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for each set's own band and the one below; the last 8
    bits of a signature are its band, the MARK bits before them its hash.

    Of its signatures in a band a set gives the least k + 1 + ``more`` by hash. Of two linked sets the
    one with f of them shares at least f - k, so the j-th that they share is among the least k + j of
    both: of those given they share at least all but k of what either one gives.

    Nearly all that is shuffled are signatures, and zeros take next to no room there. Two different
    ones that are equal by chance add a pair to be verified and lose none.
    """
    sizes = np.diff(starts)
    own = bands.band(sizes)
    spread = mixed(values ^ np.uint64(0xA24BAED4963EE407))
    high, low = (spread >> np.uint64(32)).astype(np.float64), (spread & np.uint64(0xFFFFFFFF)).astype(np.float64)
    sets, sigs = [], []
    for lower in (0, 1):
        band, first, slot = _slots(starts, values, bands, lower)
        n = int(first[-1])
        filled = np.bincount(slot, minlength=n) > 0
        of = np.repeat(np.arange(len(sizes)), np.diff(first))
        # where nothing may differ, linked sets are equal: no signatures are needed
        there = np.flatnonzero(filled & (own[of] >= lower) & (bands.differ[band[of]] > 0))
        of = of[there]
        with np.errstate(over="ignore"):  # sums of halves are whole below 2^53, so for 2^21 shingles in a slot
            total = (np.bincount(slot, high, n)[there].astype(np.uint64) << np.uint64(32)) + np.bincount(slot, low, n)[there].astype(np.uint64)
            number = (there - first[of]).astype(np.uint64)
            sig = mixed(total + mixed(number * np.uint64(256) + band[of].astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MARK)
        order = np.lexsort((sig, of))
        of, sig = of[order], sig[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        given = rank < (bands.differ + 1 + bands.more)[band[of]]
        of, sig = of[given], sig[given]
        sets.append(of)
        sigs.append((sig << np.uint64(8)) | band[of].astype(np.uint64))
    return np.concatenate(sets), np.concatenate(sigs).view(np.int64)


# -- passes over the texts ----------------------------------------------------
def with_keys(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, key of the set, its band, and its spare signatures there and one band below.

    ``row`` is the row's place, as ``F.monotonically_increasing_id()`` has it."""
    bands = Bands()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            starts, values = shingle_sets(texts_of(batch.column(2)))
            spare, below = spares(starts, values, bands)
            sizes = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(set_keys(starts, values)), pa.array(bands.band(sizes)), pa.array(spare), pa.array(below)],
                names=["row", "doc_id", "n_shingles", "key", "band", "spare", "spare_below"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_shingles long, key long, band long, spare long, spare_below long")


def with_signatures(docs: DataFrame) -> DataFrame:
    """(bucket, id): signatures and keys of the distinct sets; a task gives a set once."""
    bands = Bands()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches(frames):
            starts, values = shingle_sets(texts_of(batch.column(0)))
            keys = set_keys(starts, values)
            new = np.zeros(len(keys), dtype=bool)
            for i, key in enumerate(keys.tolist()):
                if key and key not in done:
                    done.add(key)
                    new[i] = True
            keep = np.repeat(new, np.diff(starts))
            starts = np.concatenate([[0], np.cumsum(np.where(new, np.diff(starts), 0))])
            which, sigs = signatures(starts, values[keep], bands)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(keys[which])], names=["bucket", "id"])

    return docs.select("text").mapInArrow(run, "bucket long, id long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, items, size, bits) for ``wanted`` (id, row): the hashes of each row's set as bytes, and their parities.

    Only the texts of those rows are read into sets. Their numbers are sent to
    every task if there are at most SENT of them; else the rows are joined.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    few = wanted.limit(SENT + 1).count() <= SENT
    picked = rows.join(F.broadcast(wanted) if few else wanted, "row")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            starts, values = shingle_sets(texts_of(batch.column(1)))
            items = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            bits = pa.ListArray.from_arrays(np.arange(len(items) + 1, dtype=np.int32) * PARITY, parities(starts, values).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary()), pa.array(np.diff(starts)), bits], names=["id", "items", "size", "bits"])

    return picked.select("id", "text").mapInArrow(run, "id long, items binary, size long, bits array<long>")


def similar(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity, by whole intersection.

    Sets differ in at least as many shingles as in parities, and linked ones in at most
    (q - p) / (q + p) of both sizes, so only the sets of pairs that this allows are shuffled.
    """
    p, q = share
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(k), F.col("size").alias(f"size_{k}"), F.col("bits").alias(f"bits_{k}")), k)
    allowed = (q + p) * bits_apart("bits_a", "bits_b", PARITY) <= (q - p) * (F.col("size_a") + F.col("size_b"))
    pairs = step(pairs.filter(allowed).select("a", "b"), "allowed")
    if no_rows(pairs):
        return pairs
    sets = maybe(sets.select("id", "items"), pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(q * same >= p * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


# -- the join -----------------------------------------------------------------
def _band(bucket: str) -> Column:
    return F.col(bucket).bitwiseAND(F.lit(255))


def _could_link(a: str, b: str, shared: Column) -> Column:
    """The bound for two hard sets that share ``shared`` rare shingles: a link
    differs in at most (q - p) / (q + p) of both sizes."""
    p, q = SHARE
    most = (q - p) * (F.col(f"size_{a}") + F.col(f"size_{b}"))
    rare = F.col(f"rare_{a}") + F.col(f"rare_{b}") - 2 * shared
    whole = F.abs(F.col(f"size_{a}") - F.col(f"rare_{a}") - F.col(f"size_{b}") + F.col(f"rare_{b}"))
    apart = F.aggregate(F.zip_with(f"parts_{a}", f"parts_{b}", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda n, x: n + x)
    return ((q + p) * (rare + whole) <= most) & ((q + p) * (rare + apart) <= most)  # the first is cheap and weaker


def _single(items: DataFrame) -> DataFrame:
    """(id, item): the shingles of sets (id, items) one by one."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            values = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(values))], names=["id", "item"])

    return items.select("id", "items").mapInArrow(run, "id long, item long")


def scant_links(scant: DataFrame, items: DataFrame) -> DataFrame:
    """Links that join up every two linked sets of ``scant`` (id)."""
    held = step(_single(items.join(scant, "id", "left_semi")), "held")
    members = step(shared_only(held.select(F.col("item").alias("bucket"), "id")), "members")
    of = lambda ids: held.join(ids, "id", "left_semi")
    return all_bucket_links(members, of, lambda pairs: similar(pairs, items), SHARE)


def hard_links(hard: DataFrame, items: DataFrame, plain: DataFrame) -> DataFrame:
    """Links between hard sets, as many as join up every component, and those of the pairs ``plain``; ``hard`` has
    their crowded (bucket, id), ``items`` the sets."""
    held = step(_single(items.join(hard.select("id").distinct(), "id", "left_semi")), "items")
    seen = held.groupBy("item").agg(F.count("*").alias("n"))
    counted = held.join(seen, "item")
    rare, group = counted.filter(F.col("n") <= CROWD), F.pmod(F.xxhash64("item"), F.lit(GROUPS))
    common = [F.count(F.when((F.col("n") > CROWD) & (group == k), 1)) for k in range(GROUPS)]
    info = step(counted.groupBy("id").agg(
        F.count("*").alias("size"), F.count(F.when(F.col("n") <= CROWD, 1)).alias("rare"), F.array(*common).alias("parts")), "info")

    def about(side: str, name: str | None = None) -> DataFrame:
        return info.select(F.col("id").alias(name or side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "rare", "parts")])

    by_item = rare.filter("n > 1").groupBy("item").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most CROWD
    pairs = F.transform("ids", lambda x, k: F.transform(F.slice("ids", k + 2, F.lit(CROWD)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    met = by_item.select(F.explode(F.flatten(pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("met"))
    rare_pairs = met.join(about("a"), "a").join(about("b"), "b").filter(_could_link("a", "b", F.col("met"))).select("a", "b")

    # the rest share no rare shingle
    members = hard.join(info, "id")
    heads = members.groupBy("bucket").agg(F.min(F.struct("rare", "id"))["id"].alias("head"))
    stars = members.join(heads, "bucket").filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    stars = stars.join(about("a"), "a").join(about("b"), "b").filter(_could_link("a", "b", F.lit(0))).select("a", "b")
    found = step(similar(step(plain.union(rare_pairs).union(stars).distinct(), "pairs"), items), "links")

    roots = components(found)
    now = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    part = now.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    state = part.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("n_roots"), F.min("least").alias("least"))
    now = step(now.join(state.filter("n_roots > 1"), "bucket"), "open")
    # of those outside a bucket's largest component, the ones that the bound allows any partner
    p, q = SHARE
    partner = F.greatest(q * F.col("least"), p * F.col("size")) / q
    allowed = (q + p) * (partner - F.col("size") + 2 * F.col("rare")) <= (q - p) * (partner + F.col("size"))
    side = lambda df, k: df.select("bucket", F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("root", "size", "rare", "parts")])
    outside, inside = side(now.filter((F.col("root") != F.col("main")) & allowed), "x"), side(now, "y")
    left = outside.join(inside, "bucket").filter((F.col("root_x") != F.col("root_y")) & _could_link("x", "y", F.lit(0)))
    more = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return found.union(similar(more, items))


def _counted(members: DataFrame) -> DataFrame:
    """(bucket, own, ids) of the buckets with at least two different ids: ``ids`` is the whole
    bucket and ``own`` null up to CROWD of them; a crowded bucket has a row for each id, ``own``.

    All of it is done where one shuffle by bucket has brought the members.
    """
    counted = shared_only(members).withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    own = F.when(F.col("n") > CROWD, F.col("id")).alias("own")
    return counted.groupBy("bucket", own).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between keys of different sets: all of them where one set is
    not hard, and of two hard sets as many as join up every component. ``sets``
    has a row for each key, see ``join``. Of two scant sets, too, as many as join up
    every component."""
    shared = step(_counted(with_signatures(docs)), "shared").withColumn("band", _band("bucket"))
    crowded = shared.filter(F.col("own").isNotNull()).select("bucket", "band", F.col("own").alias("id"))
    lost = crowded.groupBy("id", "band").agg(F.count("*").alias("lost"))
    spare = F.when(F.col("band") == F.col("own"), F.col("spare")).otherwise(F.col("below"))
    known = sets.select(F.col("key").alias("id"), "own", "spare", "below")
    short = lost.join(known, "id").filter(F.col("lost") > spare).select("id", "band")
    hard = step(crowded.join(short, ["id", "band"]).select("bucket", "id"), "hard")

    few = shared.filter(F.col("own").isNull())
    pairs = F.transform("ids", lambda x, k: F.transform(F.slice("ids", k + 2, F.lit(CROWD)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    met = step(few.select("band", F.explode(F.flatten(pairs)).alias("p")).groupBy("p.a", "p.b", "band").agg(F.count("*").alias("met")), "met")
    # linked sets agree in all but k of the signatures of either one, less those in crowded buckets
    for side in "ab":
        met = met.join(known.withColumnRenamed("id", side), side).join(lost.withColumnRenamed("id", side), [side, "band"], "left").filter(
            F.col("met") >= spare + 1 - F.coalesce("lost", F.lit(0))).select("a", "b", "band", "met")
    plain = step(met.select("a", "b").distinct(), "pairs")

    scant = step(known.filter((F.col("spare") < 0) | ((F.col("below") < 0) & (F.col("own") > 0))).select("id"), "scant")
    wanted = plain.select(F.explode(F.array("a", "b")).alias("id")).union(hard.select("id")).union(scant).distinct()
    items = step(sets_of(docs, step(wanted.join(sets.select(F.col("key").alias("id"), "row"), "id"), "wanted")), "sets")
    found = similar(plain, items) if no_rows(hard) else hard_links(hard, items, plain)
    return found if no_rows(scant) else found.union(scant_links(scant, items))


def join(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included) and first (whether the row is the first of its
    component by doc_id and place), one row per row of ``docs``.

    Null, empty and wordless texts have an empty set and link with nothing: their
    component is their own id, and each is the first. Equal sets are linked
    without comparison. Repeated rows are rows of one component; null ids are
    passed over for a component's id unless all its ids are null. Other columns
    are not read. No rows: no rows.
    """
    keys = step(with_keys(docs), "keys")
    owned = step(keys.filter("key <> 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("head"), F.min("row").alias("row"),
        F.first("band").alias("own"), F.first("spare").alias("spare"), F.first("spare_below").alias("below")), "owned")
    roots = components(step(links(docs, owned), "all"))
    group = owned.select("key", "least", "head").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    by_key = step(group.drop("head").join(least, "root").select("key", "component_id", F.col("head.row").alias("head")), "groups")
    linked = keys.filter("key <> 0").join(by_key, "key").select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("head")).alias("first"))
    return linked.union(keys.filter("key = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first row of each component; columns, whatever their names, as they were."""
    gone = join(docs).filter(~F.col("first")).select("row")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(gone, "row", "left_anti").select("doc.*")


@query("op7_partenum_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
