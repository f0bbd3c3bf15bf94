"""Researched corrections: plan, apply, roll back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import parse, vocab
from meguri.functions.address import (
    block_key, block_key_text, canonical_address, city_of, prefecture_of_city, with_address,
)
from meguri.functions.names import is_unnamed, normalize_name
from meguri.functions.text import blank_to_null
from meguri.operators.filters import select_lines
from meguri.session import settled, spread

MIN_UNITS = 6
UPDATABLE, CREATABLE = "更新可能", "新規登録"
_CHANGE = "struct<field:string,old_value:string,new_value:string>"


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_canonical": canonical_address(F.col("address")), "_block": block_key_text(F.col("address")),
        "_name": normalize_name(F.col("building_name")),
    })


def match_rows(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Add matched_id, match_kind, match_reason, needs_review, is_new.

    By id; else by canonical address, several narrowed by name; else by block,
    where the stored address must be a leading part of the row's, again
    narrowed by name; else new.  Stored rows are counted per key beforehand,
    and a row looks up the leading parts of its own address, so no block is
    paired with itself.
    """
    stored = settled(_keyed(current.select("id", "address", "building_name")), "current")
    asked = settled(_keyed(spread(rows)), "asked")
    has_id = F.col("building_id") != ""
    by_address = stored.groupBy("_canonical").agg(F.count("*").alias("_n"), F.min("id").alias("_one"))
    by_both = stored.groupBy("_canonical", "_name").agg(F.count("*").alias("_nn"), F.min("id").alias("_named"))
    per_block = stored.filter("_block is not null").groupBy("_block").agg(F.count("*").alias("_in_block"))

    with_id = asked.filter(has_id).join(stored.select(F.col("id").alias("matched_id")), F.col("building_id") == F.col("matched_id"), "left")
    missing = F.concat(F.lit("building_id が見つかりません（"), "building_id", F.lit("）。"))
    by_id = with_id.withColumns({
        "match_kind": F.when(F.col("matched_id").isNotNull(), "id"),
        "match_reason": F.when(F.col("matched_id").isNull(), missing),
        "needs_review": F.lit(False), "is_new": F.lit(False),
    })

    nothing = asked.filter(~has_id & (F.col("address") == "")).withColumns({
        "matched_id": F.lit(None).cast("string"), "match_kind": F.lit(None).cast("string"),
        "match_reason": F.lit("building_id と住所のどちらもありません。"), "needs_review": F.lit(False), "is_new": F.lit(False),
    })

    named = (F.col("_name") != "") & (F.col("building_name") != vocab.UNKNOWN_NAME)
    addressed = settled(
        asked.filter(~has_id & (F.col("address") != ""))
        .join(by_address, "_canonical", "left").join(by_both, ["_canonical", "_name"], "left"), "addressed",
    )
    exact = addressed.filter("_n is not null")
    one, narrowed = F.col("_n") == 1, named & (F.col("_nn") == 1)
    many = F.concat(F.lit("同じ住所に "), F.col("_n").cast("string"), F.lit(" 件あり、建物名でも 1 件に絞れません。"))
    by_exact = exact.withColumns({
        "matched_id": F.when(one, F.col("_one")).when(narrowed, F.col("_named")),
        "match_kind": F.when(one, "address_one").otherwise("address_many"),
        "match_reason": F.when(one, "住所の完全一致で照合しました。").when(narrowed, "住所と建物名の一致で照合しました。").otherwise(many),
        "needs_review": ~(one | F.coalesce(narrowed, F.lit(False))), "is_new": F.lit(False),
    })

    rest = addressed.filter("_n is null").drop("_n", "_one", "_nn", "_named").join(per_block, "_block", "left")
    lengths = F.sequence(F.lit(1), F.length("_canonical"))
    parts = rest.filter("_in_block is not null and _canonical <> ''").select(
        "line", "_block", "_name", F.explode(F.transform(lengths, lambda n: F.col("_canonical").substr(F.lit(1), n))).alias("_canonical")
    )
    in_block = stored.filter("_block is not null")
    lead = in_block.groupBy("_block", "_canonical").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    lead_named = in_block.groupBy("_block", "_canonical", "_name").agg(F.count("*").alias("nn"), F.min("id").alias("named"))
    hits = parts.join(lead, ["_block", "_canonical"]).join(lead_named, ["_block", "_canonical", "_name"], "left")
    counted = hits.groupBy("line").agg(
        F.sum("n").alias("_n"), F.min("one").alias("_one"), F.coalesce(F.sum("nn"), F.lit(0)).alias("_nn"), F.min("named").alias("_named"),
    )
    blocked = rest.join(counted, "line", "left")
    one, several = F.col("_n") == 1, F.col("_n") > 1
    narrowed = several & named & (F.col("_nn") == 1)
    block = F.concat(F.lit("街区（"), "_block", F.lit("）"))
    by_block = blocked.withColumns({
        "matched_id": F.when(one, F.col("_one")).when(narrowed, F.col("_named")),
        "match_kind": F.when(one, "block_prefix_one").when(several, "block_prefix_many").when(F.col("_block").isNull(), "address_unreadable")
        .when(F.col("_in_block").isNotNull(), "block_no_prefix").otherwise("block_absent"),
        "match_reason": F.when(one, F.concat(F.lit("号まで一致する建物が無いため、"), block, F.lit("で照合しました。")))
        .when(narrowed, F.concat(block, F.lit("内で建物名の一致により照合しました。")))
        .when(several, F.concat(block, F.lit("に "), F.col("_n").cast("string"), F.lit(" 件あり、どの棟か決められません。")))
        .when(F.col("_in_block").isNotNull(), F.concat(block, F.lit("に "), F.col("_in_block").cast("string"), F.lit(" 件あるが、住所の並びが一致しませんでした。")))
        .otherwise("DB に該当する建物がないため、新規登録の候補です。"),
        "needs_review": F.coalesce(several & ~F.coalesce(narrowed, F.lit(False)), F.lit(False)),
        "is_new": F.col("_n").isNull(),
    })
    keep = [*rows.columns, "matched_id", "match_kind", "match_reason", "needs_review", "is_new"]
    out = by_id.select(*keep)
    for part in (nothing, by_exact, by_block):
        out = out.unionByName(part.select(*keep))
    return out


def with_address_decision(df: DataFrame, current: str, proposed: str, out: str) -> DataFrame:
    """Add struct(kind, reason): none, detail, or conflict.

    Only the same place written in more detail is accepted.
    """
    staged = df.withColumns({
        "_old": block_key(F.col(current)), "_new": block_key(F.col(proposed)),
        "_old_text": canonical_address(F.col(current)), "_new_text": canonical_address(F.col(proposed)),
    })
    old, new = F.col("_old"), F.col("_new")
    arrow = lambda part: F.concat(
        F.lit("（"), old[part].cast("string"), F.lit(" → "), new[part].cast("string"), F.lit("）。"))
    conflict = (
        F.when(old.isNull() | new.isNull(), "住所から丁目・番を読み取れませんでした。")
        .when(old["town"] != new["town"], F.concat(F.lit("町名が違います"), arrow("town")))
        .when(old["chome"] != new["chome"], F.concat(F.lit("丁目が違います"), arrow("chome")))
        .when(old["block"] != new["block"], F.concat(F.lit("番が違います"), arrow("block")))
        .when(~F.col("_new_text").startswith(F.col("_old_text")), "既存住所の続きになっていません。")
    )
    unchanged = (F.col(proposed) == "") | (F.col("_old_text") == F.col("_new_text"))
    staged = staged.withColumn("_conflict", F.when(~unchanged, conflict))
    kind = F.when(unchanged, "none").when(F.col("_conflict").isNotNull(), "conflict").otherwise("detail")
    decided = staged.withColumn(out, F.struct(kind.alias("kind"), F.col("_conflict").alias("reason")))
    return decided.drop("_old", "_new", "_old_text", "_new_text", "_conflict")


def _change(condition: Column, field: str, old: Column, new: Column) -> Column:
    row = F.struct(F.lit(field).alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    return F.when(condition, row)


def plan_research(rows: DataFrame, current: DataFrame, overwrite: bool = False, allow_create: bool = False) -> DataFrame:
    """Verdict and changes per row of a checked research list.

    ``rows`` are quality.check_research_rows without errors.  Adds matched_id,
    match_kind, verdict, changes (array of field, old, new) and reasons.
    """
    matched = match_rows(rows, current)
    cur = current.select(
        F.col("id").alias("matched_id"),
        F.struct(*[F.col(c) for c in ("building_name", "address", "total_units", "property_type", "building_type")]).alias("cur"),
    )
    staged = matched.join(cur, "matched_id", "left").withColumn("_current", F.col("cur.address"))
    staged = with_address_decision(staged, "_current", "address", "_address").withColumns({
        "_units": parse.count_of_research(F.col("total_units")),
        "_type": parse.property_type_of_research(F.col("property_type")),
        "_source": parse.research_source(F.col("source")),
        "_readable": block_key_text(F.col("address")).isNotNull(),
    })
    staged = settled(staged, "research")  # the decisions below read these columns many times

    name, old_name = F.col("building_name"), F.col("cur.building_name")
    found = F.col("matched_id").isNotNull()
    gives_name = (name != "") & (name != vocab.UNKNOWN_NAME)
    empty_name = is_unnamed(old_name)
    differs = gives_name & ~empty_name & (F.trim(old_name) != name)
    name_conflict = differs & F.lit(not overwrite)
    take_name = gives_name & (empty_name | (differs & F.lit(overwrite)))
    units, kind = F.col("_units.value"), F.col("_type.value")
    b_type = F.col("building_type")
    changes = F.array_compact(F.array(
        _change(take_name, "building_name", old_name, name),
        _change(F.col("_address.kind") == "detail", "address", F.col("cur.address"), F.col("address")),
        _change(units.isNotNull() & ~units.eqNullSafe(F.col("cur.total_units")), "total_units", F.col("cur.total_units"), units),
        _change(kind.isNotNull() & ~kind.eqNullSafe(F.col("cur.property_type")), "property_type", F.col("cur.property_type"), kind),
        _change((b_type != "") & (b_type != F.coalesce("cur.building_type", F.lit(""))), "building_type", F.col("cur.building_type"), b_type),
    ))
    none = F.lit(None).cast("string")
    enough = units.isNull() | (units >= MIN_UNITS)
    creatable = F.col("is_new") & F.lit(allow_create) & gives_name & F.col("_readable") & enough
    created = F.array_compact(F.array(
        _change(F.lit(True), "building_name", none, name), _change(F.lit(True), "address", none, F.col("address")),
        _change(units.isNotNull(), "total_units", none, units), _change(kind.isNotNull(), "property_type", none, kind),
        _change(b_type != "", "building_type", none, b_type),
    ))
    address_conflict = F.col("_address.kind") == "conflict"
    review = F.col("_units.error").isNotNull() | F.col("_type.error").isNotNull() | F.col("_source.error").isNotNull()
    verdict = (
        F.when(~found & creatable, CREATABLE).when(~found & F.col("needs_review"), "要確認").when(~found, "照合不可")
        .when(name_conflict, "建物名競合").when(address_conflict, "住所競合").when(review, "要確認")
        .when(F.size(changes) == 0, "変更なし").otherwise(UPDATABLE)
    )
    held = F.concat(F.lit("既に「"), old_name, F.lit("」が入っています。CSV は「"), name, F.lit("」です。"))
    over = F.concat(F.lit("既存の「"), old_name, F.lit("」を上書きします。"))
    reasons = F.array_compact(F.array(
        F.col("match_reason"),
        F.when(~found & F.col("is_new") & F.lit(allow_create) & ~creatable, "新規登録に必要な情報が足りません。"),
        F.when(found & name_conflict, held), F.when(found & differs & F.lit(overwrite), over),
        F.when(found & address_conflict, F.col("_address.reason")),
        F.when(found, F.col("_units.error")), F.when(found, F.col("_type.error")), F.when(found, F.col("_source.error")),
    ))
    empty = F.array().cast(f"array<{_CHANGE}>")
    return staged.withColumns({
        "verdict": verdict, "reasons": reasons,
        "changes": F.when(found, changes).when(creatable, created).otherwise(empty),
    }).select(*rows.columns, "matched_id", "match_kind", "verdict", "changes", "reasons")


@dataclass
class Applied:
    buildings: DataFrame
    audit: DataFrame  # schemas.FIELD_UPDATES
    counts: DataFrame  # applied, created


def _patch(buildings: DataFrame, values: DataFrame, keep_null: Column) -> DataFrame:
    """Write field values (id, field_name, value, seq) into buildings; the last wins.

    ``keep_null`` says for which fields a NULL value is written as well.
    """
    value_of = lambda f: F.max_by(F.struct("value"), F.when(F.col("field_name") == f, F.col("seq")))
    wide = values.groupBy("id").agg(*[value_of(f).alias(f"_{f}") for f in vocab.RESEARCH_FIELDS])
    wide = wide.withColumns({f"_{f}": F.when(F.col(f"_{f}.value").isNotNull() | keep_null[f], F.col(f"_{f}")) for f in vocab.RESEARCH_FIELDS})
    # Normal forms are worked out for the changed rows alone, before the join.
    wide = with_address(wide, "_address.value", "_addr").withColumn("_name_key", normalize_name(F.col("_building_name.value")))
    joined = buildings.join(wide, "id", "left")
    new = {f: F.col(f"_{f}.value") for f in vocab.RESEARCH_FIELDS}
    has = {f: F.col(f"_{f}").isNotNull() for f in vocab.RESEARCH_FIELDS}
    pick = lambda f, value: F.when(has[f], value)
    out = joined.withColumns({
        "normalized_building_name": pick("building_name", F.col("_name_key")).otherwise(F.col("normalized_building_name")),
        "building_name": pick("building_name", F.coalesce(new["building_name"], F.lit(""))).otherwise(F.col("building_name")),
        "normalized_address": pick("address", F.col("_addr.normalized")).otherwise(F.col("normalized_address")),
        "address": pick("address", new["address"]).otherwise(F.col("address")),
        "total_units": pick("total_units", new["total_units"].try_cast("int")).otherwise(F.col("total_units")),
        "property_type": pick("property_type", F.coalesce(new["property_type"], F.lit("unknown"))).otherwise(F.col("property_type")),
        "building_type": pick("building_type", new["building_type"]).otherwise(F.col("building_type")),
    })
    if "name_source" in buildings.columns:
        out = out.withColumn("name_source", F.when(has["building_name"], "csv").otherwise(F.col("name_source")))
    return out.select(*buildings.columns)


def _inserts(rows: DataFrame, columns: list[str]) -> DataFrame:
    pick = lambda f: F.try_element_at(F.filter("changes", lambda c: c["field"] == f), F.lit(1))["new_value"]
    made = with_address(rows.withColumn("_a", pick("address")), "_a", "_addr")
    city = city_of(F.col("_a"))
    out = made.select(
        F.col("new_id").alias("id"), pick("building_name").alias("building_name"),
        normalize_name(pick("building_name")).alias("normalized_building_name"), F.col("_a").alias("address"),
        F.col("_addr.normalized").alias("normalized_address"),
        F.coalesce("_addr.prefecture", prefecture_of_city(city)).alias("prefecture"), city.alias("city"),
        pick("total_units").try_cast("int").alias("total_units"), F.coalesce(pick("property_type"), F.lit("unknown")).alias("property_type"),
        pick("building_type").alias("building_type"), F.lit("import").alias("source"),
        F.lit(vocab.NOT_DISTRIBUTED).alias("status"), F.lit(0).cast("long").alias("distribution_count"),
    )
    return out.select(*[c for c in out.columns if c in columns])


def apply_research(buildings: DataFrame, plan: DataFrame, chosen: DataFrame, batch: str) -> Applied:
    """Apply the chosen lines that may be applied; one audit row per field.

    ``chosen`` has ``line``.  Counts, dates and status are never touched.
    ``batch`` names this application and no other: it is part of every id.
    """
    updates = select_lines(plan, chosen, [UPDATABLE]).filter(F.size("changes") > 0)
    made = select_lines(plan, chosen, [CREATABLE]).withColumn("new_id", F.sha2(F.concat_ws("|", F.lit(batch), F.col("line").cast("string")), 256))
    both = updates.withColumn("_id", F.col("matched_id")).unionByName(made.withColumn("_id", F.col("new_id")).drop("new_id"))
    fields = both.select("line", "_id", "source", "note", F.posexplode("changes").alias("pos", "c"))
    audit = fields.select(
        F.xxhash64(F.lit(batch), "line", "pos").alias("id"), (F.col("line") * 10 + F.col("pos")).cast("long").alias("seq"), F.lit(batch).alias("batch_id"),
        F.col("_id").alias("building_id"), F.col("c.field").alias("field_name"), F.col("c.old_value").alias("old_value"),
        F.col("c.new_value").alias("new_value"), blank_to_null(F.col("source")).alias("source"), blank_to_null(F.col("note")).alias("note"),
    )
    audit = settled(audit, "audit")
    values = audit.join(made.select(F.col("new_id").alias("building_id")), "building_id", "left_anti").select(
        F.col("building_id").alias("id"), "field_name", F.col("new_value").alias("value"), "seq"
    )
    never = {f: F.lit(False) for f in vocab.RESEARCH_FIELDS}
    patched = _patch(buildings, values, never).unionByName(_inserts(made, buildings.columns), allowMissingColumns=True)
    kinds = updates.select(F.lit(1).alias("applied"), F.lit(0).alias("created")).unionByName(
        made.select(F.lit(0).alias("applied"), F.lit(1).alias("created"))
    )
    counts = kinds.agg(F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum("created"), F.lit(0)).alias("created"))
    return Applied(patched, audit, counts)


def roll_back(buildings: DataFrame, audit: DataFrame, batch: str) -> DataFrame:
    """Put back each field's oldest value in the batch.

    An address cannot go back to nothing and is left; a building the batch
    created therefore stays, without a name.
    """
    first = audit.filter(F.col("batch_id") == batch).groupBy("building_id", "field_name").agg(F.min_by(F.struct("old_value"), "seq").alias("o"))
    values = first.select(
        F.col("building_id").alias("id"), "field_name", F.col("o.old_value").alias("value"), F.lit(0).cast("long").alias("seq")
    )
    back = {f: F.lit(f != "address") for f in vocab.RESEARCH_FIELDS}
    kept = [c for c in buildings.columns if c != "name_source"]
    patched = _patch(buildings.select(*kept), values, back)
    if "name_source" not in buildings.columns:
        return patched
    return patched.join(buildings.select("id", "name_source"), "id").select(*buildings.columns)
