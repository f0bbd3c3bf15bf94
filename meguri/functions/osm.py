"""Map elements: address, name, units and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.text import nfkc, trim_space
from meguri.functions.use import first_term, term_category


def tag(tags: Column, key: str) -> Column:
    """A tag's trimmed value, NULL when absent or blank."""
    return F.nullif(trim_space(F.try_element_at(tags, F.lit(key))), F.lit(""))


def _raw(tags: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))


def _chome(value: Column) -> Column:
    return F.when(value.rlike("^[0-9０-９]+$"), F.concat(value, F.lit("丁目"))).otherwise(value)


def address_of_tags(tags: Column, prefecture: str | None = None, city: str | None = None) -> Column:
    """Address text, the area filling what the tags lack; NULL without a
    town or without any number."""
    full = tag(tags, "addr:full")
    if prefecture and city:
        full = F.when(~full.contains(city), F.concat(F.lit(prefecture + city), full)).otherwise(full)
    town_parts = [
        tag(tags, "addr:suburb"), _chome(tag(tags, "addr:quarter")),
        _chome(tag(tags, "addr:neighbourhood")), tag(tags, "addr:street"),
    ]
    town = F.concat_ws("", *town_parts)
    numbers = F.concat_ws("-", tag(tags, "addr:block_number"), tag(tags, "addr:housenumber"))
    area = F.concat(
        F.coalesce(tag(tags, "addr:province"), F.lit(prefecture or "")),
        F.coalesce(tag(tags, "addr:city"), F.lit(city or "")),
    )
    built = F.when((town != "") & (numbers != ""), F.concat(area, town, numbers))
    return F.coalesce(full, built)


def name_of_tags(tags: Column) -> Column:
    """P20: the first name tag that has a value."""
    return F.coalesce(*[tag(tags, k) for k in vocab.NAME_TAGS])


def units_of_tags(tags: Column) -> Column:
    """P20: units from the first tag whose digits, run together, exceed 0.

    Digits are concatenated as they stand: "12;14" reads as 1214.
    """
    counts = [F.regexp_replace(F.try_element_at(tags, F.lit(k)), "[^0-9]", "").try_cast("int") for k in vocab.UNIT_TAGS]
    return F.coalesce(*[F.when(n > 0, n) for n in counts])


def convert_elements(elements: DataFrame, prefecture: str | None = None, city: str | None = None) -> DataFrame:
    """map elements -> source records with the first rule that refuses each.

    ``elements``: type, id, lat, lon, center, tags.  Adds accepted, reason,
    detail and the record's columns; refused rows keep them for the report.
    """
    t = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    staged = elements.withColumn("tags", t)
    tags = F.col("tags")
    place = F.coalesce("center", F.when(
        F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    ))
    mixed = F.coalesce(*[
        F.when(_raw(tags, k).isNotNull(), F.concat(F.lit(k + "="), _raw(tags, k))) for k in vocab.MIXED_USE_TAGS
    ])
    staged = staged.withColumns({
        "_name": name_of_tags(tags), "_building": F.coalesce(F.lower(tag(tags, "building")), F.lit("")),
        "_residential": F.lower(tag(tags, "residential")), "_use": _raw(tags, "building:use"), "_mixed": mixed,
        "total_units": units_of_tags(tags), "_address": address_of_tags(tags, prefecture, city), "_place": place,
    }).withColumn("_folded_name", nfkc(F.col("_name")))
    staged = staged.withColumn("_term", first_term(F.col("_folded_name")))
    staged = staged.withColumn("_category", term_category(F.col("_term")))

    name_multi = F.coalesce(F.col("_category") == "residential_multi", F.lit(False))
    name_off = F.col("_category").isNotNull() & ~name_multi
    building = F.col("_building")
    homes = F.col("total_units").isNotNull() | F.coalesce(F.col("_residential") == "apartments", F.lit(False)) | name_multi
    off_use = F.coalesce(F.col("_use") != "residential", F.lit(False))
    rules = [
        (F.col("_mixed").isNotNull(), "mixed_use", F.concat(F.lit("住居以外の用途タグ "), "_mixed", F.lit(" が付いているため対象外"))),
        (off_use, "mixed_use", F.concat(F.lit("building:use="), "_use", F.lit(" のため対象外"))),
        (F.col("_residential").isin(vocab.NON_APARTMENT_RESIDENTIAL), "dormitory",
         F.concat(F.lit("residential="), "_residential", F.lit(" のため対象外"))),
        ((building == "housing") & ~homes, "not_multi_dwelling", F.lit("building=housing だが集合住宅と判断できる根拠がないため対象外")),
        (~building.isin("housing", "apartments"), "not_multi_dwelling",
         F.concat(F.lit("building="), F.when(building == "", "（なし）").otherwise(building), F.lit(" は配布対象の集合住宅ではない"))),
        (name_off, "name_excluded", F.concat(F.lit("建物名「"), "_name", F.lit("」に「"), "_term", F.lit("」が含まれるため対象外"))),
        (F.col("_address").isNull() & F.col("_place").isNull(), "no_address", F.lit("住所タグも座標も無いため登録しない")),
    ]
    refusals = [F.when(c, F.struct(F.lit(name).alias("reason"), text.alias("detail"))) for c, name, text in rules]
    staged = staged.withColumn("_refused", F.try_element_at(F.array_compact(F.array(*refusals)), F.lit(1)))
    has_address = F.col("_address").isNotNull()
    return staged.select(
        "type", "id", F.col("_refused").isNull().alias("accepted"), "_refused.reason", "_refused.detail",
        F.concat(F.lit("osm:"), "type", F.lit("/"), F.col("id").cast("string")).alias("source_ref"),
        F.coalesce("_name", F.lit(vocab.UNKNOWN_NAME)).alias("building_name"),
        F.coalesce("_address", F.lit("")).alias("address"),
        F.when(has_address, "source").alias("address_source"), F.when(has_address, "housenumber").alias("address_precision"),
        F.coalesce(tag(tags, "addr:province"), F.lit(prefecture)).alias("prefecture"),
        F.coalesce(tag(tags, "addr:city"), F.lit(city)).alias("city"),
        F.lit(None).cast("string").alias("town"), F.lit("unknown").alias("property_type"),
        building.alias("building_use_raw"), "total_units",
        F.col("_place.lat").alias("latitude"), F.col("_place.lon").alias("longitude"),
    )
