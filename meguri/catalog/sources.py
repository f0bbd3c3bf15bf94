"""Queries: readers and writers.

The lists are first written out from the derived tables by Spark, into the
shared work folder, and then read back through the readers.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meguri.catalog.base import Tables, query
from meguri.functions import vocab
from meguri.session import allow_shift_jis, new_path
from meguri.sources import csv_files as C
from meguri.sources import landed as D
from meguri.sources import pages as P


def _written(df, label: str, **options) -> str:
    path = new_path(df.sparkSession, label)
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


_NOTE = "concat('第',CAST(building_id AS STRING),'棟, \"別館\"',chr(10),'2行目')"


@query("s1_csv_scan", f"SELECT CAST(building_id AS VARCHAR) AS building_id, building_name, {_NOTE} AS note FROM buildings".replace("AS STRING", "AS VARCHAR"))
def s1(t: Tables):
    """Quotes, doubled quotes and line breaks inside a cell survive."""
    rows = t.buildings.select(F.col("building_id").cast("string"), "building_name", F.expr(_NOTE).alias("note"))
    return C.read_csv(t.spark, _written(rows, "s1")).select("building_id", "building_name", "note")


@query("s1_mixed_folder", "SELECT CAST(building_id AS VARCHAR) AS building_id, building_name, address, CASE WHEN building_id % 2 = 0 THEN town END AS town FROM buildings")
def s1_mixed(t: Tables):
    """One folder, two layouts: other columns in another order, the second in Shift_JIS."""
    k, path = F.col("building_id"), new_path(t.spark, "s1-mixed")
    text = t.buildings.select(k.cast("string").alias("building_id"), "building_name", "address", "town")
    allow_shift_jis(t.spark)
    text.filter(k % 2 == 0).write.options(header=True, escape='"').csv(path)
    text.filter(k % 2 == 1).select("address", "building_id", "building_name").write.options(
        header=True, escape='"', encoding="Shift_JIS").mode("append").csv(path)
    return C.read_csv(t.spark, path).select("building_id", "building_name", "address", "town")


@query("s2_building_list", """
SELECT building_name, address, city, town, prefecture, total_units, property_type, latitude, longitude FROM
 (SELECT building_name, address, city, town, CAST(NULL AS VARCHAR) AS prefecture, total_units,
  CASE building_id % 3 WHEN 0 THEN 'rental' WHEN 1 THEN 'condominium' ELSE 'unknown' END AS property_type,
  CASE WHEN building_id % 6 = 5 THEN NULL ELSE latitude END AS latitude, longitude FROM buildings WHERE building_id % 9 <> 4)""")
def s2(t: Tables):
    return _list(t).records.select(
        "building_name", "address", "city", "town", "prefecture", "total_units", "property_type", "latitude", "longitude")


def _list(t: Tables):
    k = F.col("building_id")
    kind = F.when(k % 3 == 0, "賃貸").when(k % 3 == 1, "分譲マンション").otherwise("")
    rows = t.buildings.select(
        F.concat(F.lit(" "), "building_name").alias("建物名"), F.when(k % 9 != 4, F.col("address")).alias("住所"),
        F.when(F.col("total_units").isNotNull(), F.concat(F.col("total_units").cast("string"), F.lit("戸"))).alias("総戸数"), kind.alias("種別"),
        F.when(k % 6 == 5, "999").otherwise(F.col("latitude").cast("string")).alias("緯度"), F.col("longitude").cast("string").alias("経度"))
    return C.building_list(C.read_csv(t.spark, _written(rows, "s2")), "csv", "list")


@query("s2_rejected_rows", "SELECT count(*) AS count, '住所が空です' AS reason FROM buildings WHERE building_id % 9 = 4")
def s2_rejects(t: Tables):
    return _list(t).rejects.groupBy("reason").agg(F.count("*").alias("count"))


@query("s3_file_encodings", """SELECT 'utf-8' AS encoding, count(*) AS count FROM buildings WHERE building_id % 2 = 0
UNION ALL SELECT 'shift_jis', count(*) FROM buildings WHERE building_id % 2 = 1""")
def s3(t: Tables):
    """A folder with files of both encodings, read as one list; rows per encoding."""
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = t.buildings.select("building_id", "building_name", "address")
    path = new_path(t.spark, "s3")
    rows.filter("building_id % 2 = 0").write.option("header", True).csv(path)
    rows.filter("building_id % 2 = 1").write.mode("append").options(header=True, encoding="Shift_JIS").csv(path)
    found = C.file_encodings(t.spark, path + "/*.csv").select(F.col("path").alias("file"), "encoding")
    read = C.read_csv(t.spark, path + "/*.csv")
    good = read.filter(F.col("address").contains("区"))  # a wrong charset would break this
    return good.join(found, "file").groupBy("encoding").agg(F.count("*").alias("count"))


@query("s4_header_mapping", "SELECT building_id AS line, building_name, address, CAST(total_units AS VARCHAR) AS total_units FROM buildings")
def s4(t: Tables):
    rows = t.buildings.select("building_id", F.col("building_name").alias("物件名"), F.col("address").alias("所在地（番地まで）"), F.col("total_units").cast("string").alias("総世帯数"))
    m = C.map_headers([c for c in rows.columns if c != "building_id"])
    return rows.select(F.col("building_id").alias("line"), *[F.col(m[f]).alias(f) for f in ("building_name", "address", "total_units")])


@query("s5_hint_mapping", "SELECT row_no AS line, building_name, address, CAST(distributed_date AS VARCHAR) AS distributed_date FROM past_list")
def s5(t: Tables):
    rows = t.past_list.select("row_no", F.col("distributed_date").cast("string").alias("配布年月日"), F.col("building_name").alias("Building Name"), F.col("address").alias("所在"))
    m = C.guess_mapping([c for c in rows.columns if c != "row_no"])
    return rows.select(F.col("row_no").alias("line"), *[F.col(f"`{m[f]}`").alias(f) for f in ("building_name", "address", "distributed_date")])


@query("s6_distribution_list", """
SELECT CASE WHEN row_no % 2 = 0 THEN building_name ELSE '（建物名なし）' END AS building_name, trim(address) AS address,
 CASE WHEN row_no % 3 = 0 THEN DATE '2026-03-31' ELSE distributed_date END AS distributed_date, '配布班' AS distributed_by FROM past_list""")
def s6(t: Tables):
    k = F.col("row_no")
    rows = t.past_list.select(
        F.when(k % 2 == 0, F.col("building_name")).alias("建物名"), "address", F.when(k % 3 != 0, F.date_format("distributed_date", "yyyy年M月d日")).otherwise("不明").alias("配布日"),
        F.lit("配布班").alias("担当者")).withColumnRenamed("address", "住所")
    done = C.distribution_list(C.read_csv(t.spark, _written(rows, "s6")), date(2026, 3, 31))
    return done.select("building_name", "address", "distribution.distributed_date", "distribution.distributed_by")


@query("s7_completion_list", """
SELECT CAST(building_id AS VARCHAR) AS building_id, CASE WHEN building_id % 4 = 3 THEN 'status が不正です（MAYBE）。許可値: CONFIRMED / HIGH / AMBIGUOUS / NOT_FOUND'
 WHEN building_id % 4 < 2 AND building_id % 7 = 0 THEN concat('status が ',CASE building_id % 4 WHEN 0 THEN 'CONFIRMED' ELSE 'HIGH' END,' なのに building_name が空です。') END AS error FROM buildings""")
def s7(t: Tables):
    k = F.col("building_id")
    status = F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "HIGH").when(k % 4 == 2, "ambiguous").otherwise("maybe")
    rows = t.buildings.select(
        F.col("building_id").cast("string").alias("Building_ID"), "address", F.when(k % 7 != 0, F.col("building_name")).alias("building_name"),
        status.alias("status"), F.lit("homes").alias("source"), F.lit(None).cast("string").alias("note"))
    return C.completion_list(C.read_csv(t.spark, _written(rows, "s7"))).select("building_id", "error")


@query("s8_research_list", "SELECT CAST(building_id AS VARCHAR) AS building_id, building_name, coalesce(CAST(total_units AS VARCHAR),'') AS total_units, false AS is_error FROM buildings")
def s8(t: Tables):
    rows = t.buildings.select(F.col("building_id").cast("string").alias("building_id"), "building_name", "address", F.col("total_units").cast("string").alias("total_units"))
    done = C.research_list(C.read_csv(t.spark, _written(rows, "s8")))
    return done.select("building_id", "building_name", "total_units", F.col("error").isNotNull().alias("is_error"))


@query("s9_map_elements", """
SELECT building_id AS id, 'way' AS type, building_name AS name, CASE WHEN building_id % 2 = 0 THEN latitude END AS lat, CASE WHEN building_id % 2 = 1 THEN latitude END AS center_lat FROM buildings""")
def s9(t: Tables):
    """Responses of 50 elements each, as JSON documents."""
    even = F.col("building_id") % 2 == 0
    element = F.struct(
        F.lit("way").alias("type"), F.col("building_id").alias("id"), F.when(even, F.col("latitude")).alias("lat"), F.when(even, F.col("longitude")).alias("lon"),
        F.when(~even, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("center"),
        F.create_map(F.lit("building"), F.lit("apartments"), F.lit("name"), F.col("building_name")).alias("tags"))
    response = t.buildings.groupBy(F.floor(F.col("building_id") / 50).alias("g")).agg(F.collect_list(element).alias("elements")).drop("g")
    path = new_path(t.spark, "s9")
    response.write.json(path)
    read = D.elements_of(t.spark.read.schema(D.schemas.MAP_ELEMENTS).json(path))
    return read.select("id", "type", F.col("tags")["name"].alias("name"), "lat", F.col("center.lat").alias("center_lat"))


@query("s10_block_points", "SELECT concat(substr(town,7),'町') AS town, block, latitude, longitude FROM points WHERE point_id % 10 NOT IN (3,4)")
def s10(t: Tables):
    """A positional list in Shift_JIS; rows without a coordinate or a block are dropped."""
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    k, blank = F.col("point_id") % 10, F.lit("")
    rows = t.points.select(
        F.lit("東京都").alias("都道府県名"), F.lit("荒川区").alias("市区町村名"), F.concat(F.col("town").substr(F.lit(7), F.lit(99)), F.lit("町")).alias("大字"), blank.alias("小字"),
        F.when(k != 4, F.col("block")).alias("街区符号"), F.lit("9").alias("座標系"), blank.alias("X"), blank.alias("Y"),
        F.when(k == 3, "不明").otherwise(F.col("latitude").cast("string")).alias("緯度"), F.col("longitude").cast("string").alias("経度"))
    return D.read_block_points(t.spark, _written(rows, "s10", encoding="Shift_JIS")).select("town", "block", "latitude", "longitude")


@query("s11_payload", """
SELECT CASE WHEN building_id % 5 <> 0 THEN concat('api:',CAST(building_id AS VARCHAR)) END AS source_ref, CASE WHEN building_id % 4 = 0 THEN '（建物名なし）' ELSE building_name END AS building_name,
 address, property_type, total_units FROM buildings WHERE building_id % 7 <> 0""")
def s11(t: Tables):
    k = F.col("building_id")
    rows = t.buildings.select(
        F.when(k % 5 != 0, k.cast("string")).alias("id"), F.when(k % 4 != 0, F.col("building_name")).otherwise(" ").alias("name"),
        F.when(k % 7 != 0, F.col("address")).alias("address"), F.col("property_type").alias("type"), F.col("total_units").cast("string").alias("units"),
        F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lng"))
    path = new_path(t.spark, "s11")
    rows.write.json(path)
    return D.read_payload(t.spark, path, "api").select("source_ref", "building_name", "address", "property_type", "total_units")


def _listing_pages(t: Tables):
    """Listing pages of the buildings of one town each, in the markup the readers know."""
    entry = F.concat(
        F.lit('<div><a href="https://archive.example/archive/b-'), F.col("building_id").cast("string"), F.lit('/"><h2><span class="font-bold">'),
        F.when(F.col("building_id") % 8 != 0, F.col("building_name")).otherwise(" "), F.lit("</span></h2><p>\n  "), F.col("city"), F.col("town"), F.col("chome").cast("string"),
        F.lit("丁目"), F.when(F.col("building_id") % 9 != 0, F.concat(F.col("block").cast("string"), F.lit("-"), F.col("house").cast("string"))).otherwise(""), F.lit("\n</p></a></div>"))
    # Ten buildings to a page at most, so no page grows with the data.
    page = t.buildings.groupBy(F.floor(F.col("building_id") / 10).alias("page_id")).agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("building_id", entry.alias("e")))), lambda x: x["e"])).alias("html"))
    return page.select(F.col("page_id").cast("long").alias("page_id"), F.lit("https://archive.example/list").alias("url"), "html")


@query("s12_listing_candidates", """
SELECT building_name AS name, concat(city,town,CAST(chome AS VARCHAR),'丁目',CAST(block AS VARCHAR),'-',CAST(house AS VARCHAR)) AS address FROM buildings WHERE building_id % 8 <> 0 AND building_id % 9 <> 0""")
def s12(t: Tables):
    return P.listing_candidates(_listing_pages(t)).select("name", "address")


@query("s13_index_links", """
SELECT concat('https://archive.example/archive/list/tokyo/arakawa-city/',lower(town),CAST(chome AS VARCHAR),'-addr/') AS url, town, chome FROM buildings GROUP BY town, chome""")
def s13(t: Tables):
    """Index pages that mention each link many times; the first mention counts."""
    link = F.concat(
        F.lit('<li><a href="/archive/list/tokyo/arakawa-city/'), F.lower("town"), F.col("chome").cast("string"), F.lit('-addr/" class="x"> <span>'), "town",
        F.translate(F.col("chome").cast("string"), "123456", "一二三４５６"), F.lit("丁目</span></a></li>"))
    pages = t.buildings.select(F.col("building_id").alias("page_id"), F.concat(link, link).alias("html"))
    return P.chome_links(pages, "arakawa-city", "https://archive.example")


@query("s14_configured_extraction", """
SELECT page_id, regexp_extract(html,'<nav><ul><li><a href="([^"]*)"',1) AS first_link, len(regexp_extract_all(html,'<li><a href="')) AS items
FROM pages WHERE html LIKE '%<nav><ul><li><a href="%'""")
def s14(t: Tables):
    """Links of the navigation list of every page: the first, and how many."""
    items = P.extract_items(t.table("pages"), "nav li", {"link": {"selector": "a", "attribute": "href"}, "label": {"selector": "a"}})
    per_page = items.groupBy("page_id").agg(F.min_by("link", "pos").alias("first_link"), F.count("*").alias("items"))
    return per_page


@query("s14_listing_records", """
SELECT building_name, concat(city,town,CAST(chome AS VARCHAR),'丁目',CASE WHEN building_id % 9 <> 0 THEN concat(CAST(block AS VARCHAR),'-',CAST(house AS VARCHAR)) ELSE '' END) AS address, city,
 concat('site:https://archive.example/archive/b-',CAST(building_id AS VARCHAR),'/') AS source_ref FROM buildings WHERE building_id % 8 <> 0
UNION ALL SELECT '（建物名なし）', concat(city,town,CAST(chome AS VARCHAR),'丁目',CASE WHEN building_id % 9 <> 0 THEN concat(CAST(block AS VARCHAR),'-',CAST(house AS VARCHAR)) ELSE '' END), city,
 concat('site:https://archive.example/archive/b-',CAST(building_id AS VARCHAR),'/') FROM buildings WHERE building_id % 8 = 0""")
def s14_records(t: Tables):
    fields = {"building_name": {"selector": "span.font-bold"}, "address": {"selector": "p"}, "detail_url": {"selector": "a", "attribute": "href"}}
    items = P.extract_items(_listing_pages(t), "div", fields)
    return P.distinct_records(P.listing_records(items, "site")).select("building_name", "address", "city", "source_ref")


@query("s15_town_index", "SELECT DISTINCT town FROM buildings")
def s15(t: Tables):
    item = F.concat(F.lit("<ul><li> "), "town", F.lit("（"), F.col("block").cast("string"), F.lit("件） </li></ul>"))
    pages = t.buildings.select(F.col("building_id").alias("page_id"), F.lit("https://archive.example/").alias("url"), item.alias("html"))
    return P.town_index(pages, "li")


@query("s16_records_in_area", """
SELECT min(building_id) AS row_no, address, building_name FROM buildings WHERE city = 'NATIONB区' AND (building_id % 2 = 0 OR prefecture = 'AME県') GROUP BY address, building_name""")
def s16(t: Tables):
    rows = t.buildings.withColumnRenamed("building_id", "row_no").withColumn("prefecture", F.when(F.col("row_no") % 2 == 1, F.col("prefecture")))
    return C.records_in_area(rows, "AME県", "NATIONB区").select("row_no", "address", "building_name")


@query("s17_unknown_name_export", """
SELECT id AS building_id, city, address, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '（建物名不明）' ELSE '' END AS current_building_name FROM master WHERE CAST(id AS BIGINT) % 4 <> 3""")
def s17(t: Tables):
    """Written as the export and read back: the BOM is gone, and the text whole."""
    k = F.col("id").cast("long") % 4
    name = F.when(k == 0, vocab.UNKNOWN_NAME).when(k == 1, "").when(k == 3, F.col("building_name"))
    path = new_path(t.spark, "s17")
    C.write_export(C.unnamed_buildings(t.master.withColumn("building_name", name)), path)
    read = C.read_csv(t.spark, path)
    return read.select("building_id", "city", "address", F.coalesce("current_building_name", F.lit("")).alias("current_building_name"))


@query("s18_inserted_buildings", """
SELECT concat('n',CAST(building_id AS VARCHAR)) AS id, building_name, lower(address) AS normalized_address, coalesce(property_type,'unknown') AS property_type, 'NOT_DISTRIBUTED' AS status FROM buildings""")
def s18(t: Tables):
    from meguri.operators.quality import prepare_rows
    from meguri.plans.ingest import new_buildings
    rows = prepare_rows(t.buildings.withColumnRenamed("building_id", "row_no").withColumn("building_use_raw", F.lit("apartments")))
    made = new_buildings(rows.withColumn("building_id", F.concat(F.lit("n"), F.col("row_no").cast("string"))), "data_source")
    return made.select("id", "building_name", "normalized_address", "property_type", "status")


@query("u4_distinct_candidates", """
SELECT DISTINCT building_name AS name, concat(city,town,CAST(chome AS VARCHAR),'丁目',CAST(block AS VARCHAR),'-',CAST(house AS VARCHAR)) AS address FROM buildings WHERE building_id % 8 <> 0 AND building_id % 9 <> 0""")
def u4(t: Tables):
    twice = P.listing_candidates(_listing_pages(t)).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("page_id", F.col("page_id") + F.col("again") * 1_000_000_000).drop("again")
    return P.distinct_candidates(twice).select("name", "address")
