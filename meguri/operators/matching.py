"""Duplicate matching of targets against served buildings.

The rule compares every target with every served building.  Here only pairs
that can match are formed, by keys that lose none:

* equal normalized address: one lookup per address; these targets are done;
* localities that agree (equal, or one ends the other): the agreeing pairs of
  *distinct* localities are worked out first, then rows meet on the locality
  plus block numbers, or plus a name key when the blocks say little;
* 30 m: rows meet on a grid cell.

Candidates are wanted best first, and the address score bounds the order: a
target that already has enough candidates above what the weak keys can score
skips them.  That is exact, and it is what keeps a crowded locality from
pairing all its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meguri.functions import geo, vocab
from meguri.functions.address import with_address
from meguri.functions.names import with_name
from meguri.functions.parse import metres_text, percent_text
from meguri.functions.similarity import (
    APART, JARO_WEIGHT, address_score, block_relation, common_depth, compared_names, levenshtein_ratio, name_similarity, round4,
    same_locality,
)
from meguri.operators.dedup import order_columns, top_per_key
from meguri.session import only_where, settled


@dataclass(frozen=True)
class Thresholds:
    prefix_name: float = 0.45
    divergent_name: float = 0.85
    unknown_block_name: float = 0.60
    same_place_m: float = 10.0
    nearby_m: float = 30.0
    nearby_name: float = 0.50


def with_match_columns(df: DataFrame) -> DataFrame:
    """Add ``addr`` (P1) and ``name`` (P6-P8) unless they are stored already."""
    out = df if "addr" in df.columns else with_address(df, "address", "addr")
    return out if "name" in df.columns else with_name(out, "building_name", "name")


def _side(df: DataFrame, label: str) -> DataFrame:
    kept = with_match_columns(df)
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_columns(kept))])
    return kept.select(
        F.struct(
            "id", "addr", "name", F.col("latitude").cast("double").alias("latitude"),
            F.col("longitude").cast("double").alias("longitude"), order.alias("order"),
        ).alias(label)
    )


def exact_matches(t: DataFrame, e: DataFrame) -> DataFrame:
    """Targets whose normalized address a served building has: (t, e).

    The two first served rows per address are enough: one, or the other when
    the first is the target itself.
    """
    keyed = e.withColumn("_key", F.col("e.addr.normalized")).filter("_key <> ''")
    firsts = top_per_key(keyed, ["_key"], ["e.order"], 2, "_n")
    two = firsts.groupBy("_key").agg(
        F.max(F.when(F.col("_n") == 1, F.col("e"))).alias("e1"),
        F.max(F.when(F.col("_n") == 2, F.col("e"))).alias("e2"),
    )
    pairs = t.withColumn("_key", F.col("t.addr.normalized")).join(two, "_key")
    pick = F.when(F.col("e1.id") != F.col("t.id"), F.col("e1")).otherwise(F.col("e2"))
    return pairs.select("t", pick.alias("e")).filter(F.col("e").isNotNull())


def _agreeing_localities(t: DataFrame, e: DataFrame) -> DataFrame:
    """(t_loc, e_loc): distinct localities that are equal or of which one ends the other."""
    lt = t.select(F.col("t.addr.locality").alias("t_loc")).filter("t_loc <> ''").distinct()
    le = e.select(F.col("e.addr.locality").alias("e_loc")).filter("e_loc <> ''").distinct()
    tails = lambda c: F.transform(
        F.when(F.length(c) > 3, F.sequence(F.lit(2), F.length(c) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: c.substr(i, F.length(c)),
    )
    equal = lt.join(le, lt["t_loc"] == le["e_loc"])
    longer_e = le.withColumn("t_loc", F.explode(tails(F.col("e_loc")))).join(lt, "t_loc").select("t_loc", "e_loc")
    longer_t = lt.withColumn("e_loc", F.explode(tails(F.col("t_loc")))).join(le, "e_loc").select("t_loc", "e_loc")
    return equal.unionByName(longer_e).unionByName(longer_t)


def _key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def _blocks_text(blocks: Column, n: Column | None = None) -> Column:
    return F.array_join(blocks if n is None else F.slice(blocks, F.lit(1), n), "-")


def _prefixes(blocks: Column, last: Column) -> Column:
    lengths = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: _blocks_text(blocks, n))


# Characters of folded names, rarest first (fixed order; the rest, mostly kanji,
# come before these).
_COMMON_CHARS = "qxjvlcpwdfzbyhgktmsnreouia0123456789"


def shared_share(score: float) -> float:
    """The least share of either name's letters that two names of this score or
    more have in common, unless their first four letters or their skeletons agree.

    An edit ratio of s keeps s of the letters.  Jaro-Winkler of w with at most
    three leading letters means Jaro of j = (w - 0.3) / 0.7 or more, hence m
    common letters with m (1/a + 1/b) >= 3 j - 1, and so m >= (3 j - 2) a.
    """
    jaro = (score / JARO_WEIGHT - 0.3) / 0.7
    return min(score, 3 * jaro - 2)


def name_keys(name: Column, share: float) -> Column:
    """Keys of which two names share at least one, if they have ``share`` > 0 of
    their letters in common, the first four letters or the skeleton.

    The first four letters; the consonant skeleton; and the rarest letters
    (numbered by occurrence), as many as must hit a common one: of the
    canonical form and, as names without one are compared by it, of the surface.
    """
    none = F.array().cast("array<string>")

    def form_keys(text: Column, mark: str) -> Column:
        letters = F.filter(F.split(text, ""), lambda c: c != "")

        def numbered(c: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c))
            rank = F.lpad(F.position(c, F.lit(_COMMON_CHARS)).cast("string"), 2, "0")
            return F.concat(rank, c, nth.cast("string"))

        need = F.ceil(F.size(letters) * share - 1e-9).cast("int")
        by_rarity = F.array_sort(F.transform(letters, numbered))
        rare = F.slice(by_rarity, F.lit(1), F.greatest(F.size(letters) - need + 1, F.lit(1)))
        lead = F.array(F.concat(F.lit(f"{mark}l:"), F.substring(text, 1, 4)))
        return F.when(F.length(text) > 0, F.concat(lead, F.transform(rare, lambda k: F.concat(F.lit(f"{mark}c:"), k)))).otherwise(none)

    skeleton = F.when(F.length(name["skeleton"]) > 0, F.array(F.concat(F.lit("s:"), name["skeleton"]))).otherwise(none)
    return F.array_distinct(F.concat(form_keys(name["canonical"], ""), skeleton, form_keys(name["normalized"], "n")))


def _score_ceiling(a: Column, b: Column) -> Column:
    """A cheap bound the name score cannot exceed, from lengths and shared letters."""
    x, y = compared_names(a, b)
    la, lb = F.length(x), F.length(y)
    without = lambda a, b: F.length(F.call_function("translate", a, b, F.lit("")))
    shared = F.least(la - without(x, y), lb - without(y, x))
    jaro = F.when(shared > 0, (shared / la + shared / lb + 1) / 3).otherwise(0.0)
    lead = F.lit(0)
    for n in (1, 2, 3, 4):
        same = (F.substring(x, 1, n) == F.substring(y, 1, n)) & (F.least(la, lb) >= n)
        lead = F.when(same, F.lit(n)).otherwise(lead)
    winkler = (jaro + lead * 0.1 * (1 - jaro)) * JARO_WEIGHT
    skeleton = (a["skeleton"] == b["skeleton"]) & (F.length(a["skeleton"]) > 0)
    return F.when(skeleton | (x == y), 1.0).otherwise(F.greatest(winkler, levenshtein_ratio(x, y)))


def _scored(pairs: DataFrame, th: Thresholds) -> DataFrame:
    """Pairs (t, e) -> those that are candidates, with scores.

    The address side and the distance say which name score is asked for; the
    name is scored only where its ceiling reaches that.
    """
    t, e = F.col("t"), F.col("e")
    relation, local, m = F.col("relation"), F.col("locality_match"), F.col("distance")
    by_address = F.when(
        local,
        F.when(relation == "equal", 0.0).when(relation == "prefix", th.prefix_name)
        .when(relation == "divergent", th.divergent_name).otherwise(th.unknown_block_name),
    )
    by_distance = F.when(m <= th.same_place_m, 0.0).when(m <= th.nearby_m, th.nearby_name)
    asked = F.col("_asked")
    rated = (
        pairs.withColumns({
            "_depth": common_depth(t["addr"]["blocks"], e["addr"]["blocks"]),
            "locality_match": same_locality(t["addr"]["locality"], e["addr"]["locality"]),
            "distance": geo.distance_m(t["latitude"], t["longitude"], e["latitude"], e["longitude"]),
        })
        .withColumn("relation", block_relation(t["addr"]["blocks"], e["addr"]["blocks"], F.col("_depth")))
        .withColumn("_asked", F.least(by_address, by_distance))
    )
    rated = only_where(rated, asked.isNotNull())
    rated = only_where(
        rated.withColumn("_ceiling", F.when(asked <= 0, 1.0).otherwise(_score_ceiling(t["name"], e["name"]))),
        F.col("_ceiling") >= asked - 1e-9,
    )
    named = rated.withColumn("_name", name_similarity(t["name"], e["name"])).filter(F.col("_name.score") >= asked)
    score = address_score(t["addr"], e["addr"], F.lit(False), local, relation, F.col("_depth"))
    return named.select(
        F.col("t.id").alias("target_id"), F.col("e.id").alias("existing_id"), F.col("e.order").alias("_order"),
        round4(score).alias("address_score"), F.col("_name.score").alias("name_score"),
        "distance", "relation", "locality_match", F.col("_name.translit").alias("translit"),
    )


def _reasons(th: Thresholds) -> Column:
    """P25: the reasons of a candidate, as texts in a fixed order."""
    name, m = F.col("name_score"), F.col("distance")
    local = F.col("locality_match")
    relation = F.col("relation")
    place = F.concat(F.lit("座標距離 "), metres_text(m))
    return F.array_compact(F.array(
        F.when(local & (relation == "equal"), "町名・街区符号が一致（住所表記のみ相違）"),
        F.when(local & (relation == "prefix") & (name >= th.prefix_name), "住所部分一致（街区符号が前方一致）"),
        F.when(local & (relation == "divergent") & (name >= th.divergent_name), "同一町名・番地相違だが建物名が高類似"),
        F.when(local & (relation == "unknown") & (name >= th.unknown_block_name), "同一町名・番地情報が不足"),
        F.when(m <= th.same_place_m, F.concat(place, F.lit("（ほぼ同一地点）")))
        .when((m <= th.nearby_m) & (name >= th.nearby_name), F.concat(place, F.lit(" かつ建物名が類似"))),
        F.concat(F.lit("住所類似度 "), percent_text(F.col("address_score"))),
        F.concat(F.lit("建物名類似度 "), percent_text(name)),
        F.when(F.col("translit"), "ローマ字 / カタカナ表記の違いを吸収して一致"),
    ))


def _close_pairs(t: DataFrame, e: DataFrame) -> DataFrame:
    """Pairs with agreeing localities whose block numbers are equal, or one a
    leading part of the other, or that agree on the first two."""
    tb, eb = F.col("t.addr.blocks"), F.col("e.addr.blocks")
    e_full = e.withColumn("_key", _key(F.col("e.addr.locality"), _blocks_text(eb))).filter(F.size(eb) > 0)
    t_part = t.withColumn("_n", F.explode(_prefixes(tb, F.size(tb)))).withColumn("_key", _key(F.col("e_loc"), F.col("_n")))
    t_full = t.withColumn("_key", _key(F.col("e_loc"), _blocks_text(tb))).filter(F.size(tb) > 0)
    e_part = e.withColumn("_n", F.explode(_prefixes(eb, F.size(eb) - 1))).withColumn(
        "_key", _key(F.col("e.addr.locality"), F.col("_n"))
    )
    two = lambda df, loc, b: df.filter(F.size(b) >= 3).withColumn("_key", _key(loc, _blocks_text(b, F.lit(2))))
    contained = t_part.join(e_full, "_key").select("t", "e")
    containing = t_full.join(e_part, "_key").select("t", "e")
    siblings = two(t, F.col("e_loc"), tb).join(two(e, F.col("e.addr.locality"), eb), "_key").select("t", "e")
    differ = (F.size(tb) >= 3) & (F.size(eb) >= 3)
    return contained.unionByName(containing).unionByName(siblings.filter(differ & (_blocks_text(tb) != _blocks_text(eb))))


# Served rows that may share a key before rows meet on a name key as well.
CROWD = 200


def _divergent_pairs(t: DataFrame, e: DataFrame, depth: int, least_name: float) -> DataFrame:
    """Pairs with agreeing localities whose blocks agree on exactly ``depth``
    numbers, among them all whose names score ``least_name`` or more.

    Rows meet on the locality and those numbers.  Where more than CROWD served
    rows share that, they must share a name key too, which every pair similar
    enough does; for scores so low that names need no letter in common, all
    rows of the key meet.
    """
    n = F.lit(depth)
    share = shared_share(least_name)

    def keyed(df: DataFrame, loc: Column, side: str) -> DataFrame:
        blocks = F.col(f"{side}.addr.blocks")
        return df.filter(F.size(blocks) > depth).withColumn("_key", _key(loc, _blocks_text(blocks, n)))

    asked, stored = keyed(t, F.col("e_loc"), "t"), keyed(e, F.col("e.addr.locality"), "e")
    apart = F.get(F.col("t.addr.blocks"), n) != F.get(F.col("e.addr.blocks"), n)
    if share <= 0:
        return asked.join(stored, "_key").select("t", "e").filter(apart)
    crowded = stored.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWD).select("_key")
    plain = asked.join(crowded, "_key", "left_anti").join(stored.join(crowded, "_key", "left_anti"), "_key")

    def by_name(df: DataFrame, side: str) -> DataFrame:
        keys = df.join(crowded, "_key", "left_semi").withColumn(f"{side}_keys", name_keys(F.col(f"{side}.name"), share))
        return keys.withColumn("_name_key", F.explode(f"{side}_keys"))

    # A pair may share several name keys: keep the meeting at the smallest one only.
    named = by_name(asked, "t").join(by_name(stored, "e"), ["_key", "_name_key"]).filter(
        F.array_min(F.array_intersect("t_keys", "e_keys")) == F.col("_name_key")
    )
    return plain.select("t", "e").unionByName(named.select("t", "e")).filter(apart)


def _blank_pairs(t: DataFrame, e: DataFrame) -> DataFrame:
    """Pairs with agreeing localities of which one side has no block number."""
    tb, eb = F.col("t.addr.blocks"), F.col("e.addr.blocks")
    stored = e.withColumn("e_loc", F.col("e.addr.locality"))
    blank_t = t.filter(F.size(tb) == 0).join(stored, "e_loc").select("t", "e")
    blank_e = t.filter(F.size(tb) > 0).join(stored.filter(F.size(eb) == 0), "e_loc").select("t", "e")
    return blank_t.unionByName(blank_e)


def _near_pairs(t: DataFrame, e: DataFrame, th: Thresholds, top: int | None) -> DataFrame:
    """Pairs within ``nearby_m`` metres, met on 3 x 3 cells; of each target's, those that may be among its best ``top``.

    Rows of one spot and locality are a class, and classes meet before rows do. Localities that do not agree give the
    address score; those that do, the least it can be. Within ``same_place_m`` every pair is a candidate whatever
    the names, so a class that meets enough rows there has no use for classes that cannot score as much.
    """
    scale = max(1.0, th.nearby_m / 30.0)
    size = (geo.LAT_CELL_30M * scale, geo.LON_CELL_30M * scale)

    def located(df: DataFrame, side: str) -> DataFrame:
        at, spot = F.col(side), F.struct(F.col(f"{side}.latitude").alias("la"), F.col(f"{side}.longitude").alias("lo"), F.col(f"{side}.addr.locality").alias("loc"))
        return df.filter(at["latitude"].isNotNull() & at["longitude"].isNotNull()).withColumn(f"{side}_spot", spot)

    asked, stored = located(t, "t"), located(e, "e")
    ts, es = F.col("t_spot"), F.col("e_spot")
    # An id counts once, so that rows that come twice do not pass for more candidates.
    once = stored.filter(F.col("e.id").isNotNull()).groupBy(F.col("e.id").alias("id")).agg(F.min("e_spot").alias("e_spot"))
    counts = once.groupBy("e_spot").agg(F.count("*").alias("n"))
    spots = stored.select("e_spot").distinct().join(counts, "e_spot", "left")
    here = asked.select("t_spot").distinct().withColumn("_cell", F.explode(geo.neighbour_cells(ts["la"], ts["lo"], *size)))
    there = spots.withColumn("_cell", geo.home_cell(es["la"], es["lo"], *size))
    m = geo.distance_m(ts["la"], ts["lo"], es["la"], es["lo"])
    near = only_where(here.join(there, "_cell").drop("_cell").withColumn("m", m), F.col("m") <= th.nearby_m)
    near = near.withColumn("local", F.coalesce(same_locality(ts["loc"], es["loc"]), F.lit(True)))
    if top is not None:
        apart = round4(levenshtein_ratio(ts["loc"], es["loc"]) * APART)
        scored = near.withColumns({
            "least": F.when(F.col("local"), 0.0).otherwise(apart), "most": F.when(F.col("local"), 1.0).otherwise(apart),
            "sure": F.when(F.col("m") <= th.same_place_m, F.col("n")).otherwise(0),
        })
        best_first = Window.partitionBy("t_spot").orderBy(F.col("least").desc())
        through = scored.withColumn("through", F.sum("sure").over(best_first))  # one more, as a target may be stored itself
        enough = F.max(F.when(F.col("through") > top, F.col("least"))).over(Window.partitionBy("t_spot"))
        near = through.withColumn("enough", enough).filter(F.col("enough").isNull() | (F.col("most") >= F.col("enough")))
    near = settled(near.select("t_spot", "e_spot", "local"), "spots")

    def meeting(local: bool, rows: DataFrame) -> DataFrame:
        return asked.join(near.filter(F.col("local") == local), "t_spot").join(rows, "e_spot").select("t", "e")

    if top is None:
        return meeting(True, stored).unionByName(meeting(False, stored))
    # Apart from its locality an address counts for nothing there, so rows of one class and name score alike.
    alike = Window.partitionBy("e_spot", "e.name").orderBy("e.order")
    few = stored.withColumn("_n", F.dense_rank().over(alike)).filter(F.col("_n") <= top + 1).drop("_n")
    return meeting(True, stored).unionByName(meeting(False, few))


def _unsaturated(placed: DataFrame, found: DataFrame, ceiling: float, top: int | None) -> DataFrame:
    """Targets without ``top`` candidates that score above ``ceiling``."""
    if top is None:
        return placed
    above = found.filter(F.col("address_score") > ceiling).select("target_id", "existing_id").distinct()
    full = above.groupBy("target_id").agg(F.count("*").alias("n")).filter(F.col("n") >= top)
    return placed.withColumn("target_id", F.col("t.id")).join(full, "target_id", "left_anti").drop("target_id")


def match_candidates(targets: DataFrame, existing: DataFrame, top: int | None = 5, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The best ``top`` candidates per target (all of them with None).

    ``targets`` and ``existing``: id, building_name, address, latitude,
    longitude.  Result: target_id, existing_id, rank, status, address_score,
    name_score, distance_meters, reasons.  A target with an exact address match
    has that one row, CONFIRMED; the rest are POSSIBLE; a target without rows
    is NOT_DISTRIBUTED (see :func:`match_verdicts`).
    """
    th = thresholds
    t = settled(_side(targets, "t"), "targets")
    e = settled(_side(existing, "e"), "existing")
    exact = exact_matches(t, e)
    open_t = t.withColumn("_id", F.col("t.id")).join(exact.select(F.col("t.id").alias("_id")), "_id", "left_anti").drop("_id")

    if top is not None:
        # Rows alike in all that is compared score alike: of each such class the first
        # ``top``, and one more for a target that is among them itself, are all that can be ranked.
        alike = ["e.addr", "e.name", "e.latitude", "e.longitude"]
        e = settled(top_per_key(e, alike, ["e.order"], top + 1, "_n").drop("_n"), "few")
    localities = _agreeing_localities(open_t, e)
    placed = settled(
        open_t.withColumn("t_loc", F.col("t.addr.locality")).join(localities, "t_loc").drop("t_loc"), "placed"
    )
    not_self = F.col("t.id") != F.col("e.id")
    pairs = _close_pairs(placed, e).unionByName(_blank_pairs(placed, e)).unionByName(_near_pairs(open_t, e, th, top))
    found = settled(_scored(pairs.filter(not_self), th), "close")
    # Blocks that agree on d numbers and then differ score at most
    # 0.45 + 0.25 d / (d + 1); a target full above that has no use for them.
    for depth, ceiling in ((1, 0.575), (0, 0.45)):
        short = settled(_unsaturated(placed, found, ceiling, top), "short")
        if not short.isEmpty():
            loose = _scored(_divergent_pairs(short, e, depth, th.divergent_name).filter(not_self), th)
            found = found.unionByName(settled(loose, "loose"))
    found = found.dropDuplicates(["target_id", "existing_id"])

    best = [F.col("address_score").desc(), F.col("name_score").desc(), F.col("_order")]
    ranked = top_per_key(found, ["target_id"], best, top or 2**31 - 1)
    fuzzy = ranked.select(
        "target_id", "existing_id", "rank", F.lit(vocab.POSSIBLE).alias("status"), "address_score", "name_score",
        round4(F.col("distance")).alias("distance_meters"), _reasons(th).alias("reasons"),
    )
    return _confirmed(exact).unionByName(fuzzy)


def _confirmed(exact: DataFrame) -> DataFrame:
    t, e = F.col("t"), F.col("e")
    rows = exact.withColumn("_name", name_similarity(t["name"], e["name"]))
    score = F.col("_name.score")
    differs = F.concat(F.lit("建物名は不一致だが住所一致を優先（建物名類似度 "), percent_text(score), F.lit("）"))
    return rows.select(
        F.col("t.id").alias("target_id"), F.col("e.id").alias("existing_id"), F.lit(1).alias("rank"),
        F.lit(vocab.CONFIRMED).alias("status"), F.lit(1.0).alias("address_score"), score.alias("name_score"),
        geo.distance_m(t["latitude"], t["longitude"], e["latitude"], e["longitude"]).alias("distance_meters"),
        F.array_compact(
            F.array(F.lit("住所完全一致（normalized_address）"), F.when(score < 1, differs))
        ).alias("reasons"),
    )


def match_verdicts(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per target: id, status, matched_id (only when confirmed), candidates."""
    found = candidates.groupBy(F.col("target_id").alias("id")).agg(
        F.max("status").alias("_max"), F.min("status").alias("status"),
        F.max(F.when(F.col("status") == vocab.CONFIRMED, F.col("existing_id"))).alias("matched_id"),
        F.count("*").alias("candidates"),
    ).drop("_max")
    return targets.select("id").join(found, "id", "left").select(
        "id", F.coalesce("status", F.lit(vocab.NOT_DISTRIBUTED)).alias("status"), "matched_id",
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    )
