"""Building-name completion and edits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meguri.functions import geo, vocab
from meguri.functions.address import block_key_text
from meguri.functions.names import is_unnamed, normalize_name
from meguri.functions.text import blank_to_null, trim_space
from meguri.operators.dedup import first_wins, top_per_key
from meguri.operators.joins import lookup_points, plan_name_updates, unseen_blocks
from meguri.session import settled

MAX_DISTANCE_M = 40.0
RUNNER_UP_RATIO = 2.5
ALTERNATIVES = 5
# Rings of cells (degrees of latitude and longitude) and the radius in metres
# that the 3 x 3 cells are sure to cover up to 60 degrees of latitude.
_RINGS = (((0.0003, 0.0006), 30.0), ((0.003, 0.006), 300.0))


def nearest_in_block(targets: DataFrame, candidates: DataFrame, n: int = ALTERNATIVES) -> DataFrame:
    """The ``n`` nearest candidates of each target's block, ranked.

    ``targets``: id, block_key, latitude, longitude; ``candidates``: block_key,
    name, address, source, latitude, longitude.  Targets look in a ring of
    cells first; whoever finds ``n`` candidates within the radius the ring
    covers is done, the rest look wider, at last through the block.  So a
    crowded block is not paired with itself.
    """
    here = ["block_key", "latitude", "longitude"]
    order = [F.col("source"), F.col("address"), F.col("name")]
    # Candidates at one point tie in distance: the first n in order suffice.
    spots = top_per_key(candidates.dropDuplicates([*here, "name", "address", "source"]), here, order, n, "_n").select(
        "block_key", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        F.struct("name", "address", "source", "latitude", "longitude").alias("candidate"),
    )
    spots = settled(spots, "candidates")
    open_t = targets.filter(F.col("block_key").isNotNull()).select("id", *here)
    m = geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"), geo.ROUND_RADIUS_M)
    ranking = [F.col("distance"), F.col("candidate.source"), F.col("candidate.address"), F.col("candidate.name")]
    rings = []
    for size, radius in (*_RINGS, (None, None)):
        if size is None:
            pairs = open_t.join(spots, "block_key")
        else:
            asked = open_t.withColumn("_cell", F.explode(geo.neighbour_cells(F.col("latitude"), F.col("longitude"), *size)))
            pairs = asked.join(
                spots.withColumn("_cell", geo.home_cell(F.col("_lat"), F.col("_lon"), *size)), ["block_key", "_cell"]
            )
        ranked = top_per_key(pairs.withColumn("distance", m), ["id"], ranking, n).select("id", "candidate", "distance", "rank")
        if size is None:
            rings.append(ranked)
            break
        ranked = settled(ranked, "ring")
        done = ranked.filter((F.col("rank") == n) & (F.col("distance") <= radius)).select("id")
        rings.append(ranked.join(done, "id", "left_semi"))
        open_t = open_t.join(done, "id", "left_anti")
    return reduce(DataFrame.unionByName, rings)


def match_names(targets: DataFrame, candidates: DataFrame, max_distance: float = MAX_DISTANCE_M,
                ratio: float = RUNNER_UP_RATIO) -> DataFrame:
    """Verdict per target, with the five nearest as alternatives.

    HIGH only when the nearest candidate is within ``max_distance``, the next is
    at least ``ratio`` times as far, and no other target of the block has the
    same nearest.  Two candidates at 0 m leave HIGH possible.
    """
    near = settled(nearest_in_block(targets, candidates), "near")
    per_target = near.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "candidate"))).alias("alternatives")  # at most five
    )
    named = targets.select("id", "block_key").join(per_target, "id", "left")
    best, second = F.try_element_at("alternatives", F.lit(1)), F.try_element_at("alternatives", F.lit(2))
    named = named.withColumns({"_best": best, "_next": second})
    key = ["block_key", "_key"]
    claim_key = F.struct("_best.candidate.source", "_best.candidate.address", "_best.candidate.name")
    named = named.withColumn("_key", F.when(F.col("_best.distance") <= max_distance, claim_key))
    claims = named.filter(F.col("_key").isNotNull()).groupBy(*key).agg(F.count("*").alias("_claims"))
    judged = named.join(claims, key, "left")

    d, d2 = F.col("_best.distance"), F.col("_next.distance")
    name = F.col("_best.candidate.name")
    metres = lambda c: F.concat(F.floor(c + 0.5).cast("string"), F.lit("m"))
    far, close = d > max_distance, F.coalesce(d2 < d * ratio, F.lit(False))
    claimed = F.coalesce(F.col("_claims") > 1, F.lit(False))
    verdict = F.when(d.isNull(), "NOT_FOUND").when(far | close | claimed, "AMBIGUOUS").otherwise("HIGH")
    reason = (
        F.when(d.isNull(), "同じ街区に候補が見つかりませんでした。")
        .when(far, F.concat(F.lit("最も近い候補でも "), metres(d), F.lit(f" 離れています（上限 {max_distance:g}m）。")))
        .when(close, F.concat(F.lit("1位「"), name, F.lit("」"), metres(d), F.lit(" と 2位「"), F.col("_next.candidate.name"), F.lit("」"), metres(d2), F.lit(" が近すぎます。")))
        .when(claimed, F.concat(F.lit("同じ街区の別の建物も「"), name, F.lit("」を最有力としています。どちらか判断できません。")))
        .otherwise(F.concat(
            F.lit("「"), name, F.lit("」("), F.col("_best.candidate.address"), F.lit(") が "), metres(d), F.lit("。"),
            F.when(d2.isNull(), "同じ街区に他の候補はありません。").otherwise(F.concat(F.lit("2位は "), metres(d2), F.lit(" で十分離れています。"))),
        ))
    )
    return judged.select(
        "id", "block_key", verdict.alias("verdict"), F.when(verdict == "HIGH", name).alias("name"),
        F.col("_best.candidate").alias("candidate"), d.alias("distance_meters"), reason.alias("reason"),
        F.coalesce("alternatives", F.array().cast(near_type(near))).alias("alternatives"),
    )


def near_type(near: DataFrame) -> str:
    candidate = near.schema["candidate"].dataType.simpleString()
    return f"array<struct<rank:int,distance:double,candidate:{candidate}>>"


@dataclass
class Completion:
    buildings: DataFrame
    lookups: DataFrame  # block_key, source: the blocks looked up
    found: DataFrame  # block_key, name, address, source: what was found there
    verdicts: DataFrame


def complete_names(buildings: DataFrame, landed: DataFrame, lookups: DataFrame, found: DataFrame, gazetteer: DataFrame,
                   source: str, prefecture: str | None = None, city: str | None = None) -> Completion:
    """Name buildings without a name from landed candidates, HIGH only.

    ``landed``: candidates read for this run (name, address, source); blocks
    already in ``lookups`` keep what was ``found`` then.  Names entered by hand
    are never touched, also when name_source is NULL on other rows.  The
    block key has city, town, chome and block, in full.
    """
    manual = F.col("name_source").eqNullSafe("manual")
    no_name = F.col("building_name").isNull() | (F.col("building_name") == vocab.UNKNOWN_NAME)
    wanted = buildings.filter(no_name & ~manual & F.col("latitude").isNotNull())
    for column, value in (("prefecture", prefecture), ("city", city)):
        wanted = wanted if value is None else wanted.filter(F.col(column) == value)
    targets = settled(
        wanted.select("id", block_key_text(F.col("address")).alias("block_key"), "latitude", "longitude")
        .filter("block_key is not null"), "unnamed",
    )
    fresh_blocks = unseen_blocks(targets, lookups, source)
    keyed = landed.filter(F.col("source") == source).withColumn("block_key", block_key_text(F.col("address")))
    fresh = keyed.join(fresh_blocks, "block_key", "left_semi").select("block_key", "name", "address", "source")
    fresh = first_wins(fresh, ["block_key", "name", "address"], ["source"])
    all_found = found.select("block_key", "name", "address", "source").unionByName(fresh)
    counts = fresh.groupBy("block_key").agg(F.count("*").alias("candidate_count")).withColumn("source", F.lit(source))
    located = lookup_points(all_found.filter(F.col("source") == source), gazetteer).filter("latitude is not null")
    in_scope = located.join(targets.select("block_key").distinct(), "block_key", "left_semi")
    known_blocks = lookups.filter(F.col("source") == source).select("block_key").unionByName(counts.select("block_key")).distinct()
    verdicts = settled(match_names(targets.join(known_blocks, "block_key", "left_semi"), in_scope), "verdicts")
    decided = verdicts.filter(F.col("verdict") == "HIGH").select("id", F.col("name").alias("_name"))
    named = buildings.join(decided, "id", "left").withColumns({
        "building_name": F.coalesce("_name", "building_name"),
        "name_source": F.when(F.col("_name").isNotNull(), "auto").otherwise(F.col("name_source")),
    }).select(*buildings.columns)
    return Completion(named, lookups.unionByName(counts, allowMissingColumns=True), all_found, verdicts)


@dataclass
class NameEdits:
    buildings: DataFrame
    results: DataFrame  # id, building_name, error
    updates: DataFrame  # audit rows


def _apply_names(buildings: DataFrame, names: DataFrame, source: str) -> DataFrame:
    """Write names (id, _new) into building_name, normalized name and name_source only."""
    has = F.col("_new").isNotNull()
    keyed = names.withColumn("_new_key", normalize_name(F.col("_new")))
    return buildings.join(keyed, "id", "left").withColumns({
        "normalized_building_name": F.when(has, F.col("_new_key")).otherwise(F.col("normalized_building_name")),
        "building_name": F.coalesce("_new", "building_name"),
        "name_source": F.when(has, source).otherwise(F.col("name_source")),
    }).select(*buildings.columns)


def edit_names(buildings: DataFrame, edits: DataFrame) -> NameEdits:
    """Names typed by people (id, building_name), 1 to 200 characters.

    An edit is refused when there is no such building, when another building at
    the address has the name, or when an earlier edit (by id) takes it.  Accepted
    rows are marked manual.
    """
    text = trim_space(F.coalesce("building_name", F.lit("")))
    asked = first_wins(edits.select("id", text.alias("_new")), ["id"], ["_new"])
    asked = asked.withColumn("_key", normalize_name(F.col("_new"))).join(
        buildings.select("id", "normalized_address", F.col("building_name").alias("old_building_name"), F.lit(True).alias("_known")), "id", "left"
    )
    place = F.coalesce("normalized_address", F.lit(""))
    asked = settled(asked.withColumn("_at", F.when(place != "", place)), "edits")
    taken = buildings.join(asked.select(F.col("_at").alias("normalized_address")).distinct(), "normalized_address", "left_semi")
    taken = taken.select("id", F.col("normalized_address").alias("_at"), F.col("normalized_building_name").alias("_key"))
    holder = taken.groupBy("_at", "_key").agg(F.min("id").alias("_min"), F.max("id").alias("_max"))
    rival = asked.groupBy("_at", "_key").agg(F.min("id").alias("_first"))
    checked = asked.join(holder, ["_at", "_key"], "left").join(rival, ["_at", "_key"], "left")
    clash = F.coalesce(
        (F.col("_min") != F.col("id")) | (F.col("_max") != F.col("id")) | (F.col("_first") < F.col("id")), F.lit(False)
    )
    error = (
        F.when(F.col("_known").isNull(), "該当する建物がない")
        .when(F.col("_new") == "", "建物名を入力してください。")
        .when(F.length("_new") > 200, "建物名が長すぎます（200文字まで）。")
        .when(clash, "同じ住所に同じ建物名が既に登録されています。別の名前にするか、重複候補の確認画面で整理してください。")
    )
    checked = checked.withColumn("error", error)
    good = checked.filter(F.col("error").isNull())
    audit = good.select(
        F.col("id").alias("building_id"), "old_building_name", F.col("_new").alias("new_building_name"),
        F.lit("manual").alias("source"), F.lit("CONFIRMED").alias("status"),
    )
    return NameEdits(
        _apply_names(buildings, good.select("id", "_new"), "manual"),
        checked.select("id", F.col("_new").alias("building_name"), "error"), audit,
    )


def apply_name_list(buildings: DataFrame, checked: DataFrame) -> NameEdits:
    """Apply a checked name list; any error in it and nothing is applied.

    ``checked`` is the output of quality.check_completion_rows.
    """
    plan = settled(plan_name_updates(checked.filter(F.col("error").isNull()).drop("error"), buildings), "name-plan")
    refused = not checked.filter(F.col("error").isNotNull()).isEmpty() or not plan.filter("decision = 'error'").isEmpty()
    good = plan.filter("decision = 'update'")
    if refused:
        good = good.limit(0)
    audit = good.select(
        "building_id", F.col("current_name").alias("old_building_name"), F.col("building_name").alias("new_building_name"),
        blank_to_null(F.col("source")).alias("source"), "status", blank_to_null(F.col("note")).alias("note"),
    )
    names = good.select(F.col("building_id").alias("id"), F.col("building_name").alias("_new"))
    results = plan.select(F.col("building_id").alias("id"), "building_name", F.col("reason").alias("error"))
    return NameEdits(_apply_names(buildings, names, "csv"), results, audit)


def backfill_manual(buildings: DataFrame) -> DataFrame:
    """Rows that have a name but no name_source were named by hand."""
    named = F.col("name_source").isNull() & ~is_unnamed(F.col("building_name"))
    return buildings.withColumn("name_source", F.when(named, "manual").otherwise(F.col("name_source")))


__all__: list[str] = [
    "Completion", "NameEdits", "apply_name_list", "backfill_manual", "complete_names", "edit_names", "match_names",
    "nearest_in_block",
]
