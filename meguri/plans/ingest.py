"""Ingest of building lists and past-distribution lists.

Every job takes snapshots and returns new snapshots; the caller writes them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import geo, vocab
from meguri.functions.address import address_parts
from meguri.functions.names import with_name
from meguri.functions.text import blank_to_null
from meguri.operators import aggregates
from meguri.operators.dedup import first_wins, order_columns
from meguri.operators.joins import (
    MERGE_DISTANCE_M, comparison_scope, distributed_scope, pending_ids, resolve_new_rows, resolve_past_rows,
    same_building_names, unjudged_pairs,
)
from meguri.operators.matching import match_candidates
from meguri.operators.quality import prepare_rows
from meguri.session import settled

PAIR_KEYS = ["new_building_id", "possible_existing_building_id"]


@dataclass
class Snapshot:
    buildings: DataFrame
    history: DataFrame
    candidates: DataFrame


@dataclass
class IngestResult:
    results: DataFrame  # row_no, outcome, building_id, message, near_miss, use_unknown
    after: Snapshot


def _id_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _with_canonical(master: DataFrame) -> DataFrame:
    if "canonical" in master.columns:
        return master
    return with_name(master, "building_name", "_n").withColumn("canonical", F.col("_n.canonical")).drop("_n")


def _served_at_address(master: DataFrame) -> DataFrame:
    served = master.filter((F.col("distribution_count") > 0) & (F.coalesce("normalized_address", F.lit("")) != ""))
    order = F.struct(*order_columns(master))
    return served.groupBy("normalized_address").agg(
        F.min_by(F.struct(F.col("id").alias("id"), F.col("building_name").alias("name")), order).alias("served")
    )


def _within_batch(left: DataFrame) -> DataFrame:
    """Rows no stored building answers to, resolved among themselves.

    Rows inserted earlier in the batch are visible to later rows at the same
    address.  At one address the first row is inserted; a later past row goes to
    the inserted row of its name, else to the first; a later new row goes to the
    inserted row of its name, else to its nearest inserted neighbour within 5 m
    if the names allow, else is inserted.  All of it is minima per (address),
    (address, name) and (address, point), so no address is gathered in a task.

    Rows without an address stand alone.  A row whose nearest neighbour was
    itself merged joins the building that neighbour became.

    Adds ``into``: the row_no of the row that is inserted on its behalf.
    """
    at = F.coalesce(F.nullif(F.col("normalized_address"), F.lit("")), F.concat(F.lit("\x00"), F.col("row_no").cast("string")))
    left = left.withColumn("_at", at)
    leaders = left.groupBy("_at").agg(F.min("row_no").alias("_leader"))
    led = left.join(leaders, "_at")
    can_insert = ~F.col("is_past") | (F.col("row_no") == F.col("_leader"))
    named = led.groupBy("_at", "name_key").agg(F.min(F.when(can_insert, F.col("row_no"))).alias("_same_name"))
    ranked = settled(led.join(named, ["_at", "name_key"]), "batch")
    by_name = F.col("_same_name") <= F.col("row_no")
    first = F.when(by_name, F.col("_same_name")).when(F.col("is_past"), F.col("_leader")).otherwise(F.col("row_no"))
    ranked = ranked.withColumn("_first", first)

    # New rows that would be inserted, one per (address, name), and their points.
    would = ranked.filter((F.col("_first") == F.col("row_no")) & ~F.col("is_past") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spot = ["_at", "latitude", "longitude"]
    brief = ["row_no", "building_name", "canonical"]
    firsts = would.groupBy(*spot).agg(F.min_by(F.struct(*brief), "row_no").alias("p"))
    size = (geo.LAT_CELL_30M, geo.LON_CELL_30M)
    here = firsts.withColumn("_cell", F.explode(geo.neighbour_cells(F.col("latitude"), F.col("longitude"), *size)))
    there = firsts.select(
        "_at", F.col("p").alias("q"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"),
        geo.home_cell(F.col("latitude"), F.col("longitude"), *size).alias("_cell"),
    )
    m = geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo"))
    close = here.join(there, ["_at", "_cell"]).filter(F.col("q.row_no") < F.col("p.row_no")).withColumn("_m", m)
    ok = lambda a, b: same_building_names(a["building_name"], b["building_name"], a["canonical"], b["canonical"])
    near = (
        close.filter(F.col("_m") <= MERGE_DISTANCE_M).groupBy(*spot)
        .agg(F.min_by(F.struct("p", "q"), F.struct("_m", "q.row_no")).alias("b"))
        .select(*spot, F.when(ok(F.col("b.p"), F.col("b.q")), F.col("b.q")).alias("_joined"))
    )
    points = firsts.join(near, spot, "left").withColumn("_owner", F.coalesce("_joined", "p")).select(*spot, "p", "_joined", "_owner")
    me = F.struct(*brief)
    merged = would.join(points, spot).select(
        "row_no",
        F.when(F.col("row_no") == F.col("p.row_no"), F.col("_joined.row_no"))
        .when(ok(me, F.col("_owner")), F.col("_owner.row_no")).alias("_into"),
    ).filter("_into is not null")
    hops = merged.select(F.col("row_no").alias("_first"), F.col("_into").alias("_hop1"))
    again = merged.select(F.col("row_no").alias("_hop1"), F.col("_into").alias("_hop2"))
    out = ranked.join(hops, "_first", "left").join(again, "_hop1", "left")
    return out.withColumn("into", F.coalesce("_hop2", "_hop1", "_first")).drop(
        "_at", "_leader", "_same_name", "_first", "_hop1", "_hop2"
    )


def decide(rows: DataFrame, before: Snapshot, create_unmatched: bool = True, reject_development: bool = True,
           batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """What would happen to each input row, without writing anything.

    Returns (decisions, pairs): one row per input with outcome, building_id,
    message, near_miss; and the waiting pairs of newly inserted rows.  The
    ingest applies exactly these decisions, so preview and result agree.
    """
    prepared = settled(prepare_rows(rows, reject_development), "prepared")
    usable = prepared.filter(F.col("rejected").isNull()).drop("message")
    master = _with_canonical(comparison_scope(before.buildings, usable.select("normalized_address", "name_key", "source_ref", "city")))
    master = settled(master, "scope")

    past = resolve_past_rows(usable.filter("is_past"), master).withColumn("near_miss", F.lit(None).cast("string"))
    served = _served_at_address(master)
    fresh = usable.filter("not is_past").join(served, "normalized_address", "left")
    done = fresh.filter(F.col("served").isNotNull())
    new = resolve_new_rows(fresh.filter(F.col("served").isNull()).drop("served"), master)
    resolved = settled(
        past.unionByName(new, allowMissingColumns=True).unionByName(
            done.withColumn("target_id", F.col("served.id")).withColumn("_served_name", F.col("served.name")).drop("served"),
            allowMissingColumns=True,
        ), "resolved",
    )

    already = resolved.filter(F.col("_served_name").isNotNull())
    hit = resolved.filter(F.col("target_id").isNotNull() & F.col("_served_name").isNull())
    left = resolved.filter(F.col("target_id").isNull())

    names = master.select(F.col("id").alias("target_id"), F.col("building_name").alias("_target_name"),
                          F.col("normalized_building_name").alias("_target_key"))
    hit = hit.join(names, "target_id", "left")
    renamed = F.col("match_kind").isin("address") & (F.col("_target_key") != F.col("name_key"))
    hit_message = (
        F.when(F.col("is_past") & renamed, F.concat(F.lit("住所一致により既存物件「"), "_target_name", F.lit("」の配布履歴として登録しました")))
        .when(F.col("is_past"), F.lit(None))
        .when(F.col("match_kind") == "coordinates", F.concat(
            F.lit("住所は違うが座標が "), F.floor(F.col("match_distance") + 0.5).cast("string"),
            F.lit("m と一致するため既存の建物に統合しました")))
        .otherwise("既存の建物レコードに統合しました")
    )
    keep = [*prepared.columns, "near_miss"]

    def decided(df: DataFrame, outcome: Column, building: Column, message: Column, into: Column | None = None) -> DataFrame:
        shown = df.withColumns({"message": message.cast("string")})
        shown = shown if "near_miss" in df.columns else shown.withColumn("near_miss", F.lit(None).cast("string"))
        return shown.select(
            *keep, outcome.alias("outcome"), building.cast("string").alias("building_id"),
            (F.lit(None).cast("long") if into is None else into).alias("into"),
        )

    parts = [
        decided(prepared.filter(F.col("rejected").isNotNull()), F.col("rejected"), F.lit(None), F.col("message")),
        decided(already, F.lit("already_distributed"), F.col("target_id"),
                F.concat(F.lit("住所完全一致：既に配布済み「"), "_served_name", F.lit("」"))),
        decided(hit, F.lit("merged"), F.col("target_id"), hit_message),
    ]
    empty_pairs = None
    if create_unmatched:
        batched = _within_batch(left)
        own = F.col("into") == F.col("row_no")
        owners = left.select(
            F.col("row_no").alias("into"),
            _id_of(F.lit(batch), F.col("normalized_address"), F.col("name_key"), F.col("row_no")).alias("_new_id"),
            F.col("name_key").alias("_owner_key"), F.col("building_name").alias("_owner_name"),
        )
        batched = batched.join(owners, "into")
        joined = F.when(F.col("is_past") & (F.col("_owner_key") != F.col("name_key")), F.concat(
            F.lit("住所一致により既存物件「"), "_owner_name", F.lit("」の配布履歴として登録しました")
        )).when(~F.col("is_past"), "既存の建物レコードに統合しました")
        created = settled(
            decided(batched, F.when(own, "inserted").otherwise("merged"), F.col("_new_id"), F.when(~own, joined), F.col("into")),
            "created",
        )
        fresh_rows = created.filter((F.col("outcome") == "inserted") & ~F.col("is_past"))
        pairs = settled(match_candidates(
            fresh_rows.select(F.col("building_id").alias("id"), "building_name", "address", "addr", "name", "latitude", "longitude"),
            distributed_scope(before.buildings, usable.select("normalized_address", "name_key", "source_ref", "city")),
        ).filter(F.col("status") == vocab.POSSIBLE), "pairs")
        best = pairs.filter("rank = 1").select(
            F.col("target_id").alias("building_id"), F.array_join("reasons", " / ").alias("_why")
        )
        created = created.join(best, "building_id", "left")
        possible = F.col("_why").isNotNull() & (F.col("outcome") == "inserted")
        parts.append(created.withColumns({
            "message": F.when(possible, F.col("_why")).otherwise(F.col("message")),
            "outcome": F.when(possible, "possible_duplicate").otherwise(F.col("outcome")),
        }).select(*keep, "outcome", "building_id", "into"))
    else:
        why = F.when(F.col("is_past"), "住所も建物名も一致する建物が見つかりませんでした（新しい建物は作成しません）。").otherwise(
            "住所が一致する建物が見つかりませんでした（新しい建物は作成しません）。"
        )
        parts.append(decided(left, F.lit("skipped"), F.lit(None), why))
        pairs = empty_pairs
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, pairs


def results_of(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "row_no", "building_name", "address", "outcome", "building_id", "message", "near_miss",
        F.col("use.unknown").alias("use_unknown"),
    )


def preview(rows: DataFrame, before: Snapshot, create_unmatched: bool = True) -> DataFrame:
    """Outcome per input row; nothing is written."""
    return results_of(decide(rows, before, create_unmatched)[0])


def new_buildings(rows: DataFrame, source: str, columns: list[str] | None = None, at: datetime | None = None) -> DataFrame:
    """The stored form of inserted rows (trimmed, defaults, NULL kept NULL),
    created ``at`` that time, or now."""
    out = rows.select(
        F.col("building_id").alias("id"),
        F.coalesce(blank_to_null(F.col("building_name")), F.lit(vocab.BLANK_NAME)).alias("building_name"),
        "address", F.col("name_key").alias("normalized_building_name"), "normalized_address", "address_extra",
        "prefecture", "city", "town", "total_units",
        F.coalesce("property_type", F.lit("unknown")).alias("property_type"),
        F.col("use.use").alias("building_use"), F.col("use.reason").alias("building_use_note"),
        "latitude", "longitude", F.lit(vocab.NOT_DISTRIBUTED).alias("status"),
        F.lit(None).cast("date").alias("last_distributed_date"), F.lit(0).cast("long").alias("distribution_count"),
        F.lit(source).alias("source"), "source_ref", "address_source", "address_precision",
        (F.current_timestamp() if at is None else F.lit(at)).alias("created_at"),
    )
    return out if columns is None else out.select(*[c for c in columns if c in out.columns])


def fill_missing(buildings: DataFrame, merged: DataFrame) -> DataFrame:
    """T4: fill units, type and coordinates a building lacks from rows merged into it.

    ``merged``: building_id, row_no, total_units, property_type, latitude,
    longitude.  The first row that knows a value gives it; nothing known is
    replaced, and names and addresses are never touched.
    """
    known_type = F.when(F.col("property_type") != "unknown", F.col("property_type"))
    order = lambda c: F.when(c.isNotNull(), F.col("row_no"))
    patch = merged.groupBy(F.col("building_id").alias("id")).agg(
        F.min_by("total_units", order(F.col("total_units"))).alias("_units"),
        F.min_by(known_type, order(known_type)).alias("_type"),
        F.min_by(F.struct("latitude", "longitude"), order(F.col("latitude"))).alias("_at"),
    )
    no_place = F.col("latitude").isNull() & F.col("_at").isNotNull()
    return buildings.join(patch, "id", "left").withColumns({
        "total_units": F.coalesce("total_units", F.col("_units")),
        "property_type": F.when((F.col("property_type") == "unknown") & F.col("_type").isNotNull(), F.col("_type")).otherwise(F.col("property_type")),
        "longitude": F.when(no_place, F.col("_at.longitude")).otherwise(F.col("longitude")),
        "latitude": F.when(no_place, F.col("_at.latitude")).otherwise(F.col("latitude")),
    }).select(*buildings.columns)


def pairs_as_candidates(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        _id_of(F.col("target_id"), F.col("existing_id")).alias("id"),
        F.col("target_id").cast("string").alias(PAIR_KEYS[0]), F.col("existing_id").cast("string").alias(PAIR_KEYS[1]),
        F.col("address_score").cast("decimal(5,4)").alias("address_similarity_score"),
        F.round("name_score", 4).cast("decimal(5,4)").alias("name_similarity_score"),
        "distance_meters", F.col("reasons").alias("reason"), F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def _add(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def ingest(rows: DataFrame, before: Snapshot, source: str, create_unmatched: bool = True,
           reject_development: bool = True, batch: str = "batch", at: datetime | None = None) -> IngestResult:
    """Past rows become history of the building they name; new rows are
    merged, inserted, or set aside as possible duplicates.  ``batch`` names this
    run and no other: it is part of every new id."""
    decisions, pairs = decide(rows, before, create_unmatched, reject_development, batch)
    decisions = settled(decisions, "decisions")
    taken = decisions.filter(F.col("building_id").isNotNull())

    buildings = before.buildings
    inserted = taken.filter(F.col("into") == F.col("row_no"))
    buildings = _add(buildings, new_buildings(inserted, source, at=at))
    buildings = fill_missing(buildings, taken.filter(~F.col("is_past") & (F.col("outcome") == "merged")))

    events = taken.filter("is_past").select(
        _id_of(F.lit(batch), F.col("row_no"), F.col("building_id")).alias("id"), "building_id", "distribution.*"
    )
    history = _add(before.history, events)
    candidates = before.candidates
    if pairs is not None:
        candidates = _add(candidates, unjudged_pairs(pairs_as_candidates(pairs), before.candidates))
        waiting = pairs.select(F.col("target_id").alias("id")).distinct().withColumn("_w", F.lit(True))
        buildings = buildings.join(waiting, "id", "left").withColumn(
            "status", F.when(F.col("_w"), vocab.POSSIBLE).otherwise(F.col("status"))
        ).select(*buildings.columns)
    changed = events.select(F.col("building_id").alias("id"))
    buildings = aggregates.refresh_changed(buildings, history, candidates, changed)
    return IngestResult(results_of(decisions), Snapshot(buildings, history, candidates))


@dataclass
class Reconciled:
    after: Snapshot
    counts: DataFrame  # confirmed, possible_duplicate


def reconcile(before: Snapshot, cities: DataFrame) -> Reconciled:
    """T5: compare listed buildings of the given cities (column ``city``) with served ones.

    An exact address match confirms; otherwise new pairs are set aside, and a
    building is POSSIBLE only while a waiting pair remains.
    """
    names = cities.filter(F.coalesce("city", F.lit("")) != "").select("city").distinct()
    here = before.buildings.join(names, "city", "left_semi")
    served = here.filter(F.col("distribution_count") > 0)
    targets = here.filter((F.col("distribution_count") == 0) & (F.col("status") != vocab.CONFIRMED))
    found = settled(match_candidates(targets, served), "reconcile")

    fresh = unjudged_pairs(pairs_as_candidates(found.filter(F.col("status") == vocab.POSSIBLE)), before.candidates)
    candidates = _add(before.candidates, fresh)
    confirmed = found.filter(F.col("status") == vocab.CONFIRMED).select(F.col("target_id").alias("id")).distinct()
    waiting = (
        found.filter(F.col("status") == vocab.POSSIBLE).select(F.col("target_id").cast("string").alias("id")).distinct()
        .join(pending_ids(candidates), "id", "left_semi")
    )
    marks = confirmed.select(F.col("id").cast("string").alias("id"), F.lit(vocab.CONFIRMED).alias("_to")).unionByName(
        waiting.withColumn("_to", F.lit(vocab.POSSIBLE))
    )
    marked = before.buildings.join(marks, "id", "left")
    buildings = marked.withColumn("status", F.coalesce("_to", "status")).select(*before.buildings.columns)
    counts = marked.agg(
        F.count_if(F.col("_to") == vocab.CONFIRMED).alias("confirmed"),
        F.count_if((F.col("_to") == vocab.POSSIBLE) & (F.col("status") != vocab.POSSIBLE)).alias("possible_duplicate"),
    )
    return Reconciled(Snapshot(buildings, before.history, candidates), counts)


def mark_distributed(before: Snapshot, chosen: DataFrame, on: date, by: str = "", notes: str = "", batch: str | None = None) -> Snapshot:
    """History rows for the chosen buildings (id); their waiting pairs become
    ``same``.  ``batch`` names this marking in the ids; by default a name of its own."""
    batch = batch or uuid4().hex
    ids = chosen.select("id").distinct()
    blank = lambda v: F.nullif(F.lit(v.strip()), F.lit(""))
    events = ids.select(
        _id_of(F.lit("mark"), F.lit(batch), F.col("id"), F.lit(on.isoformat())).alias("id"), F.col("id").cast("string").alias("building_id"),
        F.lit(on).alias("distributed_date"), blank(by).alias("distributed_by"), blank(notes).alias("notes"),
    )
    history = _add(before.history, events)
    mine = ids.select(F.col("id").cast("string").alias(PAIR_KEYS[0])).withColumn("_mine", F.lit(True))
    settle = F.col("_mine") & (F.col("status") == "pending")
    candidates = before.candidates.join(mine, PAIR_KEYS[0], "left").withColumn(
        "status", F.when(settle, "same").otherwise(F.col("status"))
    ).select(*before.candidates.columns)
    buildings = aggregates.refresh_changed(before.buildings, history, candidates, ids)
    return Snapshot(buildings, history, candidates)


@dataclass
class ImportRun:
    results: DataFrame
    after: Snapshot
    reconciled: DataFrame
    batch: DataFrame


def run_import(rows: DataFrame, before: Snapshot, file_name: str, mapping: dict | None = None, batch: str | None = None) -> ImportRun:
    """Past-distribution list: ingest without creating buildings, then
    reconcile the cities the list names, then the audit row.  ``batch`` names this
    import in the ids; by default a name of its own, so that a file of the same
    name imported again makes rows of its own."""
    name = batch or f"{file_name}/{uuid4().hex}"
    done = ingest(rows, before, "import", create_unmatched=False, batch=name)
    middle = Snapshot(settled(done.after.buildings, "buildings"), done.after.history, done.after.candidates)
    cities = rows.select(address_parts(F.col("address"))["city"].alias("city"))
    reconciled = reconcile(middle, cities)
    batch = aggregates.import_batch(done.results, file_name, "distributed", mapping, name)
    return ImportRun(done.results, reconciled.after, reconciled.counts, batch)


__all__ = [
    "IngestResult", "ImportRun", "Snapshot", "decide", "fill_missing", "first_wins", "ingest", "mark_distributed",
    "new_buildings", "preview", "reconcile", "run_import",
]
