"""Key, nearest and anti joins between inputs and the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import geo, vocab
from meguri.functions.names import is_unnamed
from meguri.functions.text import trim_space
from meguri.operators.dedup import first_wins, order_columns, top_per_key
from meguri.session import only_where, settled

MERGE_DISTANCE_M = 5.0
NEAR_DISTANCE_M = 15.0
SNAP_DISTANCE_M = 200.0


def _stored(master: DataFrame, *columns: str) -> DataFrame:
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_columns(master))])
    return master.select(*columns, order.alias("_order"))


def _first_id(master: DataFrame, keys: dict[str, str], out: str) -> DataFrame:
    """Key columns (renamed) -> id of the first stored row that has them.

    One row per key, so joins to it are many-to-one and a popular address or
    name never multiplies rows.  Blank keys are left out.
    """
    rows = _stored(master, "id", *keys)
    for key in keys:
        rows = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    firsts = rows.groupBy(*keys).agg(F.min_by("id", "_order").alias(out))
    return firsts.withColumnsRenamed(keys)


def resolve_past_rows(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Add target_id and match_kind for each past-distribution row.

    Same address and name, else same address, else same exact normalized name;
    never by similarity.  ``rows`` has normalized_address and name_key.
    """
    address, name = "normalized_address", "normalized_building_name"
    both = _first_id(master, {address: "normalized_address", name: "name_key"}, "_both")
    by_address = _first_id(master, {address: "normalized_address"}, "_address")
    by_name = _first_id(master, {name: "name_key"}, "_name")
    joined = (
        rows.join(both, ["normalized_address", "name_key"], "left")
        .join(by_address, "normalized_address", "left")
        .join(by_name, "name_key", "left")
    )
    kind = (
        F.when(F.col("_both").isNotNull(), "address_and_name")
        .when(F.col("_address").isNotNull(), "address")
        .when(F.col("_name").isNotNull(), "name")
    )
    return joined.withColumns(
        {"target_id": F.coalesce("_both", "_address", "_name"), "match_kind": kind}
    ).drop("_both", "_address", "_name")


def same_building_names(incoming: Column, existing: Column, incoming_canonical: Column, existing_canonical: Column) -> Column:
    """May two records at one place be one building, by their names.

    Neither named: no.  One named: yes.  Both named: only when the canonical
    names are equal (the name score then is 1, and otherwise below 0.99).
    """
    a, b = incoming != vocab.UNKNOWN_NAME, existing != vocab.UNKNOWN_NAME
    equal = (incoming_canonical == existing_canonical) & (incoming_canonical != "")
    return F.when(a & b, equal).otherwise(a | b)


def _in_cells(df: DataFrame, lat: str, lon: str, size: tuple[float, float]) -> DataFrame:
    near = geo.neighbour_cells(F.col(lat), F.col(lon), *size)
    return df.withColumn("_cell", F.explode(near))


def _at_cell(df: DataFrame, lat: str, lon: str, size: tuple[float, float]) -> DataFrame:
    return df.withColumn("_cell", geo.home_cell(F.col(lat), F.col(lon), *size))


_CELL = (geo.LAT_CELL_30M, geo.LON_CELL_30M)


def nearest_same_address(rows: DataFrame, master: DataFrame, max_distance: float = MERGE_DISTANCE_M) -> DataFrame:
    """(row_no, near_id, distance): the nearest stored row at the same address.

    Only if that one passes the name rule; the second nearest is not tried.
    Stored rows are reduced to the first per address and point before the join.
    """
    located = master.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    located = located.filter(F.coalesce("normalized_address", F.lit("")) != "")
    points = first_wins(located, ["normalized_address", "latitude", "longitude"], order_columns(master))
    stored = _at_cell(
        points.select(
            "normalized_address", F.col("id").alias("near_id"), F.col("building_name").alias("_name"),
            F.col("canonical").alias("_canonical"), F.col("latitude").alias("_lat"),
            F.col("longitude").alias("_lon"),
            F.struct(*order_columns(master)).alias("_order"),
        ), "_lat", "_lon", _CELL,
    )
    asked = _in_cells(rows.filter("latitude is not null and longitude is not null"), "latitude", "longitude", _CELL)
    pairs = asked.join(stored, ["normalized_address", "_cell"]).withColumn(
        "distance", geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    ).filter(F.col("distance") <= max_distance)
    passes = same_building_names(F.col("building_name"), F.col("_name"), F.col("canonical"), F.col("_canonical"))
    best = pairs.groupBy("row_no").agg(
        F.min_by(F.struct("near_id", passes.alias("ok"), "distance"), F.struct("distance", "_order")).alias("b")
    )
    return best.filter("b.ok").select("row_no", "b.near_id", "b.distance")


def nearest_elsewhere(rows: DataFrame, master: DataFrame, near: float = NEAR_DISTANCE_M,
                      merge: float = MERGE_DISTANCE_M) -> DataFrame:
    """(row_no, near_id, distance, kind, reason) at a different address.

    The nearest stored row within ``near`` metres merges when within ``merge``
    and the names allow it, and is otherwise reported as near.  Stored rows are
    reduced per point to the first two of different addresses, which is all a
    row with one address can ever need.
    """
    located = master.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    keep = [
        F.col("id").alias("near_id"), F.col("normalized_address").alias("_address"),
        F.col("building_name").alias("_name"), F.col("canonical").alias("_canonical"),
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        F.struct(*order_columns(master)).alias("_order"),
    ]
    per_address = first_wins(located.select(*keep), ["_lat", "_lon", "_address"], ["_order"])
    stored = _at_cell(top_per_key(per_address, ["_lat", "_lon"], ["_order"], 2, "_n"), "_lat", "_lon", _CELL)
    asked = _in_cells(rows.filter("latitude is not null and longitude is not null"), "latitude", "longitude", _CELL)
    pairs = (
        asked.join(stored, "_cell")
        .filter(~F.col("_address").eqNullSafe(F.col("normalized_address")))
        .withColumn("distance", geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")))
        .filter(F.col("distance") <= near)
    )
    passes = same_building_names(F.col("building_name"), F.col("_name"), F.col("canonical"), F.col("_canonical"))
    best = pairs.groupBy("row_no").agg(
        F.min_by(F.struct("near_id", passes.alias("ok"), "distance"), F.struct("distance", "_order")).alias("b")
    ).select("row_no", "b.*")
    metres = F.concat(F.floor(F.col("distance") + 0.5).cast("string"), F.lit("m"))
    far = F.col("distance") > merge
    return best.select(
        "row_no", "near_id", "distance",
        F.when(~far & F.col("ok"), "merge").otherwise("near").alias("kind"),
        F.when(far, F.concat(F.lit("座標が "), metres, F.lit(" と近いが、統合の条件（5m 以内）を満たさないため別の建物として登録")))
        .when(~F.col("ok"), F.concat(F.lit("座標は "), metres, F.lit(" と近いが、建物名の条件を満たさないため統合しない")))
        .alias("reason"),
    )


def resolve_new_rows(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Add target_id, match_kind, match_distance and near_miss.

    Precedence: source id, then same address and name, then proximity at the
    same address, then coordinates elsewhere.  ``rows`` carry row_no,
    normalized_address, name_key, canonical, source_ref, latitude, longitude,
    building_name; ``master`` carries canonical.
    """
    by_ref = _first_id(master, {"source_ref": "source_ref"}, "_ref")
    both = _first_id(
        master, {"normalized_address": "normalized_address", "normalized_building_name": "name_key"}, "_both"
    )
    keyed = rows.join(by_ref, "source_ref", "left").join(both, ["normalized_address", "name_key"], "left")
    prox = nearest_same_address(rows, master).select("row_no", F.col("near_id").alias("_prox"))
    else_where = nearest_elsewhere(rows, master).select(
        "row_no", F.col("near_id").alias("_coord"), F.col("distance").alias("_coord_m"),
        F.col("kind").alias("_coord_kind"), F.col("reason").alias("_coord_reason"),
    )
    joined = keyed.join(prox, "row_no", "left").join(else_where, "row_no", "left")
    earlier = F.coalesce("_ref", "_both", "_prox")
    coord = F.when(F.col("_coord_kind") == "merge", F.col("_coord"))
    kind = (
        F.when(F.col("_ref").isNotNull(), "source_ref").when(F.col("_both").isNotNull(), "address_and_name")
        .when(F.col("_prox").isNotNull(), "proximity").when(coord.isNotNull(), "coordinates")
    )
    return joined.withColumns({
        "target_id": F.coalesce(earlier, coord),
        "match_kind": kind,
        "match_distance": F.when(earlier.isNull(), F.when(coord.isNotNull(), F.col("_coord_m"))),
        "near_miss": F.when(earlier.isNull() & (F.col("_coord_kind") == "near"), F.col("_coord_reason")),
    }).drop("_ref", "_both", "_prox", "_coord", "_coord_m", "_coord_kind", "_coord_reason")


def _snap_cell(max_distance: float) -> tuple[float, float]:
    """Cells of which 3 x 3 hold every point within ``max_distance`` metres: a degree of
    latitude is 111.2 km, and up to 79 degrees north or south one of longitude is more than a 5.55th of that."""
    lat = max_distance / 111_000
    return lat, lat * 5.55


def nearest_point(rows: DataFrame, points: DataFrame, by: list[str] | None = None,
                  max_distance: float = SNAP_DISTANCE_M, cell: tuple[float, float] | None = None) -> DataFrame:
    """Add the nearest reference point within ``max_distance`` metres.

    ``rows``: row_no, latitude, longitude; ``points``: point_id, town, block,
    latitude, longitude.  ``by`` names shared columns (such as city) that must
    agree as well.  Rows and points meet by cell, where each row appears once;
    pairs further apart go before any are gathered.
    """
    by = by or []
    cell = cell or _snap_cell(max_distance)
    known = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = known.select(
        *by, "point_id", "town", "block", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
    )
    spots = _in_cells(first_wins(spots, [*by, "_lat", "_lon"], ["point_id"]), "_lat", "_lon", cell)
    asked = rows.select("row_no", *by, "latitude", "longitude").filter("latitude is not null and longitude is not null")
    pairs = only_where(
        _at_cell(asked, "latitude", "longitude", cell).join(spots, [*by, "_cell"])
        .withColumn("_m", geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))),
        F.col("_m") <= max_distance,
    )
    best = pairs.groupBy("row_no").agg(
        F.min_by(F.struct("point_id", "town", "block", "_m"), F.struct("_m", "point_id")).alias("b")
    )
    near = best.select(
        "row_no", "b.point_id", F.col("b.town").alias("point_town"), F.col("b.block").alias("point_block"),
        F.floor(F.col("b._m") + 0.5).cast("long").alias("distance_m"),
    )
    return rows.join(near, "row_no", "left")


def complete_addresses(rows: DataFrame, points: DataFrame, prefecture: str, city: str | None = None,
                       source: str = "isj", by: list[str] | None = None) -> DataFrame:
    """Block-level address from the nearest reference point."""
    snapped = nearest_point(rows, points, by)
    found = F.col("point_id").isNotNull()
    text = F.concat(F.lit(prefecture), F.lit(city or ""), F.col("point_town"), F.col("point_block"))
    return snapped.withColumns({
        "completed_address": F.when(found, text),
        "completed_precision": F.when(found, F.lit("block")),
        "completed_source": F.when(found, F.lit(source)),
    })


def lookup_points(rows: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """Left join to a gazetteer (address, latitude, longitude) on the trimmed address."""
    known = first_wins(
        gazetteer.select(
            trim_space(F.col("address")).alias("_address"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
        ).filter("_address <> ''"), ["_address"], ["_lat", "_lon"],
    )
    keyed = rows.withColumn("_address", F.nullif(trim_space(F.col(address)), F.lit("")))
    joined = keyed.join(known, "_address", "left")
    have = {c: F.col(c) if c in rows.columns else F.lit(None).cast("double") for c in ("latitude", "longitude")}
    return joined.withColumns({
        "latitude": F.coalesce(have["latitude"], F.col("_lat")),
        "longitude": F.when(have["latitude"].isNotNull(), have["longitude"]).otherwise(F.col("_lon")),
    }).drop("_address", "_lat", "_lon")


def enrich_units(buildings: DataFrame, units: DataFrame) -> DataFrame:
    """Fill missing unit counts from a table (id, total_units); unknown stays NULL."""
    known = units.groupBy("id").agg(F.min("total_units").alias("_units"))
    return buildings.join(known, "id", "left").withColumn(
        "total_units", F.coalesce("total_units", F.col("_units"))
    ).drop("_units")


def pairs_by_block(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Targets and candidates of one block, by block_key."""
    t = targets.filter(F.col("block_key").isNotNull())
    return t.join(candidates.filter(F.col("block_key").isNotNull()), "block_key")


def unseen_blocks(targets: DataFrame, lookups: DataFrame, source: str) -> DataFrame:
    """Blocks of the targets not yet looked up at ``source``."""
    done = lookups.filter(F.col("source") == source).select("block_key")
    return targets.filter(F.col("block_key").isNotNull()).select("block_key").distinct().join(
        done, "block_key", "left_anti"
    )


def unjudged_pairs(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs never stored before; a judged pair does not come back."""
    keys = ["new_building_id", "possible_existing_building_id"]
    return pairs.join(candidates.select(*keys), keys, "left_anti")


def comparison_scope(master: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows that share an address, a name, a source id or a city with
    the batch, each once; no row cap.  Distinct keys make every semi join light."""
    def sharing(stored_key: str, row_key: str) -> DataFrame:
        keys = rows.filter(F.coalesce(F.col(row_key), F.lit("")) != "").select(F.col(row_key).alias(stored_key)).distinct()
        return master.join(keys, stored_key, "left_semi").select("id")

    ids = (
        sharing("normalized_address", "normalized_address")
        .unionByName(sharing("normalized_building_name", "name_key"))
        .unionByName(sharing("source_ref", "source_ref"))
        .unionByName(sharing("city", "city"))
    ).distinct()
    return master.join(ids, "id", "left_semi")


def distributed_scope(master: DataFrame, rows: DataFrame) -> DataFrame:
    """Served rows to compare with: same city, address or name as the batch."""
    served = master.filter(F.col("distribution_count") > 0)
    return comparison_scope(served, rows.withColumn("source_ref", F.lit(None).cast("string")))


PAIRED = 1024  # ids of one spelling to a block of them


def same_name_pairs(rows: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(building_id, other_id, score) of every two rows of one canonical name, the smaller id first.

    ``rows``: building_id, f (the features of its name). The spellings of a name are scored with each other, both
    ways round, and then met by their ids, in blocks that are dealt out: a name that many rows
    have gives as many pairs as its square, and these are made by all tasks.
    """
    rows = settled(rows.select("building_id", "f").filter("building_id is not null"), "names")
    spelt = rows.select("f").distinct()
    a = spelt.select(F.col("f.canonical").alias("c"), "f")
    b = spelt.select(F.col("f.canonical").alias("c"), F.col("f").alias("g"))
    both = a.join(b, "c").filter(F.col("f.normalized") <= F.col("g.normalized")).select(
        F.col("f.normalized").alias("a"), F.col("g.normalized").alias("b"), score(F.col("f"), F.col("g")).alias("ab"), score(F.col("g"), F.col("f")).alias("ba"))
    own = rows.select("building_id", F.col("f.normalized").alias("said"))
    counts = own.groupBy("said").agg(F.ceil(F.count("*") / PAIRED).alias("blocks"))
    dealt = own.join(counts, "said").withColumn("block", F.pmod(F.xxhash64("building_id"), F.col("blocks")))
    blocks = settled(dealt.groupBy("said", "block").agg(F.collect_list("building_id").alias("ids")), "blocks")
    named = lambda df, k: df.select(*[F.col(c).alias(f"{c}_{k}") for c in df.columns])
    met = both.join(named(blocks.drop("ids"), "a"), F.col("a") == F.col("said_a")).join(named(blocks, "b"), F.col("b") == F.col("said_b"))
    met = met.filter((F.col("a") != F.col("b")) | (F.col("block_a") <= F.col("block_b"))).select(
        "said_a", "block_a", "ab", "ba", "ids_b", ((F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))).alias("one"))
    # A row of the left, and not a block, meets each block: what one of its rows unfolds to is held as a whole.
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    left = blocks.select("said", "block", F.explode("ids").alias("x")).repartition(parts, "said", "block")
    pairs = left.join(met, (F.col("said") == F.col("said_a")) & (F.col("block") == F.col("block_a")))
    pairs = pairs.select("one", "ab", "ba", "x", F.explode("ids_b").alias("y"))
    forth = F.col("x") < F.col("y")
    return pairs.filter(forth | (~F.col("one") & (F.col("x") > F.col("y")))).select(
        F.least("x", "y").alias("building_id"), F.greatest("x", "y").alias("other_id"), F.when(forth, F.col("ab")).otherwise(F.col("ba")).alias("score"))


def pending_ids(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("status") == "pending").select(F.col("new_building_id").alias("id")).distinct()


def release_stranded(buildings: DataFrame, candidates: DataFrame) -> DataFrame:
    """POSSIBLE rows without history and without a waiting pair go back to the list."""
    waiting = pending_ids(candidates).withColumn("_waiting", F.lit(True))
    stuck = (F.col("status") == vocab.POSSIBLE) & (F.col("distribution_count") == 0) & F.col("_waiting").isNull()
    return buildings.join(waiting, "id", "left").withColumn(
        "status", F.when(stuck, vocab.NOT_DISTRIBUTED).otherwise(F.col("status"))
    ).drop("_waiting")


def requarantine(buildings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Listed rows that have a waiting pair are set aside again."""
    waiting = pending_ids(candidates).withColumn("_waiting", F.lit(True))
    back = (F.col("status") == vocab.NOT_DISTRIBUTED) & (F.col("distribution_count") == 0) & F.col("_waiting").isNotNull()
    return buildings.join(waiting, "id", "left").withColumn(
        "status", F.when(back, vocab.POSSIBLE).otherwise(F.col("status"))
    ).drop("_waiting")


def _with_both(candidates: DataFrame, buildings: DataFrame) -> DataFrame:
    fields = F.struct(*[F.col(c) for c in buildings.columns])
    new = buildings.select(F.col("id").alias("new_building_id"), fields.alias("new_building"))
    old = buildings.select(F.col("id").alias("possible_existing_building_id"), fields.alias("existing_building"))
    return candidates.join(new, "new_building_id", "left").join(old, "possible_existing_building_id", "left")


def pending_pairs(candidates: DataFrame, buildings: DataFrame, building_id=None, limit: int | None = None) -> DataFrame:
    """Waiting candidates with both buildings, best address score first.

    A limit, if asked for, is the page of the report; it is taken before the joins.
    """
    waiting = candidates.filter(F.col("status") == "pending")
    if building_id is not None:
        waiting = waiting.filter(F.col("new_building_id") == building_id)
    order = [F.col("address_similarity_score").desc(), F.col("id")]
    page = waiting if limit is None else waiting.orderBy(*order).limit(limit)
    return _with_both(page, buildings).orderBy(*order)


def resolved_pairs(candidates: DataFrame, buildings: DataFrame, limit: int | None = None) -> DataFrame:
    """Judged candidates with both buildings, latest decision first."""
    judged = candidates.filter(F.col("status") != "pending")
    order = [F.col("resolved_at").desc_nulls_first(), F.col("id")]
    page = judged if limit is None else judged.orderBy(*order).limit(limit)
    return _with_both(page, buildings).orderBy(*order)


def plan_name_updates(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Name-list rows against the master, by building id only.

    Adds current_address, current_name, decision (update, skip, error), reason.
    """
    stored = current.select(
        F.col("id").alias("building_id"), F.col("address").alias("current_address"),
        F.col("building_name").alias("current_name"), F.lit(True).alias("_found"),
    )
    joined = rows.join(stored, "building_id", "left")
    sure = F.col("status").isin("CONFIRMED", "HIGH")
    named = ~is_unnamed(F.col("current_name"))
    same = trim_space(F.col("current_name")) == trim_space(F.col("building_name"))
    reason = (
        F.when(F.col("_found").isNull(), "該当する建物がない")
        .when(~sure, "確度が不足")
        .when(named & same, "同じ名前で更新済み")
        .when(named, "既存名あり")
    )
    decision = F.when(F.col("_found").isNull(), "error").when(~sure | named, "skip").otherwise("update")
    return joined.withColumns({"decision": decision, "reason": reason}).drop("_found")
