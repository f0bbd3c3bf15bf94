"""Queries: list, filters, sorts, aggregates, dedup."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meguri.catalog.base import Tables, query
from meguri.functions import parse, vocab
from meguri.operators import aggregates as A
from meguri.operators import dedup as U
from meguri.operators import filters as L
from meguri.operators import joins as J
from meguri.session import only_where

_ALL = tuple(vocab.STATUSES)
_BASIC = ["id", "city", "total_units", "normalized_address", "building_name"]


@query("undistributed_list", """
SELECT b.building_id, b.city, b.total_units, coalesce(h.cnt,0) AS distribution_count
FROM buildings b LEFT JOIN (
  SELECT building_id, count(*) AS cnt FROM history GROUP BY building_id) h ON b.building_id = h.building_id
WHERE coalesce(h.cnt,0) = 0 AND (b.total_units >= 6 OR b.total_units IS NULL)
""")
def undistributed_list(t: Tables):
    """Buildings not yet served, under the list's default conditions."""
    rolled = A.history_rollup(t.history)
    rows = t.buildings.join(rolled, "building_id", "left").withColumn(
        "distribution_count", F.coalesce("distribution_count", F.lit(0)).cast("long")
    )
    f = L.BuildingFilter()
    return rows.filter((F.col("distribution_count") == 0) & L.units_condition(f)).select(
        "building_id", "city", "total_units", "distribution_count"
    )


@query("f1_area_filter", "SELECT id, city, town FROM master WHERE city = 'NATIONBA区' AND town = 'BUILDING' AND prefecture = 'AFR県'")
def f1(t: Tables):
    f = L.BuildingFilter(prefecture="AFR県", city="NATIONBA区", town="BUILDING")
    return t.master.filter(L.area_condition(f)).select("id", "city", "town")


@query("f2_keyword_filter", """
SELECT id, building_name, address FROM master
WHERE building_name ILIKE '%er#00000012%' OR address ILIKE '%er#00000012%' OR normalized_address ILIKE '%er#00000012%'""")
def f2(t: Tables):
    return t.master.filter(L.keyword_condition(L.BuildingFilter(keyword="er#00000012"))).select("id", "building_name", "address")


@query("f3_unit_threshold", """
SELECT id, total_units, 'or_unknown' AS policy FROM master WHERE total_units >= 10 OR total_units IS NULL
UNION ALL SELECT id, total_units, 'known_only' FROM master WHERE total_units >= 10
UNION ALL SELECT id, total_units, 'any_known' FROM master WHERE total_units IS NOT NULL""")
def f3(t: Tables):
    policies = [
        ("or_unknown", L.BuildingFilter(min_units=10)),
        ("known_only", L.BuildingFilter(min_units=10, include_unknown_units=False)),
        ("any_known", L.BuildingFilter(min_units=0, include_unknown_units=False)),
    ]
    held = F.array_compact(F.array(*[F.when(L.units_condition(f), n) for n, f in policies]))
    return t.master.select("id", "total_units", F.explode(held).alias("policy"))


@query("f4_type_and_status", """
SELECT id, property_type, status FROM master WHERE property_type IN ('rental','unknown') AND status IN ('NOT_DISTRIBUTED','POSSIBLE_DUPLICATE')
AND (total_units >= 6 OR total_units IS NULL)""")
def f4(t: Tables):
    f = L.BuildingFilter(property_types=("rental", "unknown"), statuses=("NOT_DISTRIBUTED", "POSSIBLE_DUPLICATE"))
    return L.filter_buildings(t.master, f).select("id", "property_type", "status")


@query("f5_filter_parameters", """
SELECT id, total_units FROM master WHERE city = 'NATIONH区' AND (total_units >= 8) AND status = 'CONFIRMED_DISTRIBUTED'""")
def f5(t: Tables):
    f = L.parse_filter({"city": "NATIONH区", "minUnits": "8", "unknownUnits": "0", "status": "CONFIRMED_DISTRIBUTED", "sort": "bad"})
    return L.filter_buildings(t.master, f).select("id", "total_units")


@query("f6_use_filter", """
SELECT b.building_id AS id, CASE b.building_id % 4 WHEN 0 THEN 'apartments' WHEN 1 THEN 'house' WHEN 2 THEN '店舗付きマンション' ELSE NULL END AS use_value,
 CASE b.building_id % 4 WHEN 0 THEN 'RESIDENTIAL_MULTI' ELSE 'EXCLUDED' END AS use
FROM buildings b WHERE b.building_id % 4 = 0 OR b.building_id % 7 = 0""")
def f6(t: Tables):
    from meguri.functions.use import EXCLUDED, with_use
    tag = F.when(F.col("building_id") % 4 == 0, "apartments").when(F.col("building_id") % 4 == 1, "house").when(
        F.col("building_id") % 4 == 2, "店舗付きマンション")
    rows = with_use(t.buildings.withColumn("use_value", tag), "use_value", "building_name", "_use")
    is_past = F.col("building_id") % 7 == 0
    return only_where(rows, is_past | (F.col("_use.use") != EXCLUDED)).select(
        F.col("building_id").alias("id"), "use_value", F.col("_use.use").alias("use"))


@query("f8_robots_eligibility", """
WITH u AS (SELECT url, lower(regexp_extract(url,'^[a-z]+://([^/?#:]*)',1)) AS host,
  regexp_extract(url,'^[a-z]+://[^/?#]*([^#]*)',1) AS p0 FROM pages),
v AS (SELECT url, CASE WHEN p0 LIKE '/%' THEN p0 ELSE concat('/',p0) END AS path FROM u),
m AS (SELECT url, path, path LIKE '/fr/%' AS d1, regexp_matches(path,'^/.*page=2') AS a1, regexp_matches(path,'^/en/.*5$') AS d2 FROM v)
SELECT url, NOT bool_or(CASE WHEN a1 THEN false WHEN d2 THEN true ELSE d1 END) AS allowed,
 min(CASE WHEN a1 THEN NULL WHEN d2 THEN '/en/*5$' WHEN d1 THEN '/fr/' END) AS denied_by FROM m GROUP BY url""")
def f8(t: Tables):
    """One rule group per host of the page table: two refusals and a longer permission."""
    rule = lambda kind, path: F.struct(F.lit(kind).alias("type"), F.lit(path).alias("path"))
    urls = t.table("pages").select("url")
    groups = urls.select(L.url_host(F.col("url")).alias("host")).distinct().select(
        "host", F.lit(1).alias("group_no"), F.array(F.lit("*")).alias("user_agents"),
        F.array(rule("disallow", "/fr/"), rule("allow", "/*page=2"), rule("disallow", "/en/*5$")).alias("rules"),
        F.lit(None).cast("long").alias("crawl_delay_ms"),
    )
    return L.robots_decision(urls, groups, "survey-reader/1.0").select("url", "allowed", "denied_by")


_ROBOTS_TEXT = """concat('# robots', chr(10), 'Disallow: /lost', chr(13), chr(10),
 'User-Agent: ', CASE WHEN building_id % 5 = 0 THEN 'someone-else' ELSE 'Survey-Reader' END, '  # first', chr(10),
 CASE WHEN building_id % 3 = 0 THEN concat(chr(10), 'USER-AGENT : Other', chr(10)) ELSE '' END,
 'Disallow: /a', CAST(building_id % 10 AS STRING), chr(10), 'no separator', chr(10),
 CASE building_id % 4 WHEN 0 THEN concat('Crawl-delay: 1.5', chr(10)) WHEN 1 THEN concat('crawl-delay: soon', chr(10)) ELSE '' END,
 'User-agent: *', chr(10), 'Disallow:', chr(10), 'Allow: /x', chr(10), 'Disallow: /', chr(10), 'Crawl-delay: 2', chr(10))"""


@query("f8_robots_text", """
SELECT concat('https://h',CAST(building_id AS VARCHAR),'.example/a',CAST(building_id % 7 AS VARCHAR),'/p') AS url,
 building_id % 5 <> 0 AND building_id % 10 <> building_id % 7 AS allowed,
 CASE WHEN building_id % 5 = 0 THEN '/' WHEN building_id % 10 = building_id % 7 THEN concat('/a',CAST(building_id % 10 AS VARCHAR)) END AS denied_by,
 CAST(CASE WHEN building_id % 5 = 0 THEN 2000 WHEN building_id % 4 = 0 THEN 1500 END AS BIGINT) AS crawl_delay_ms FROM buildings""")
def f8_text(t: Tables):
    """From landed robots texts to the decision on a url of each host."""
    host = F.concat(F.lit("h"), F.col("building_id").cast("string"), F.lit(".example"))
    texts = t.buildings.select(host.alias("host"), F.expr(_ROBOTS_TEXT).alias("body"))
    urls = t.buildings.select(F.concat(F.lit("https://"), host, F.lit("/a"), (F.col("building_id") % 7).cast("string"), F.lit("/p")).alias("url"))
    return L.robots_decision(urls, L.robots_groups(texts), "survey-reader/1.0").select("url", "allowed", "denied_by", "crawl_delay_ms")


@query("f9_blocked_hosts", """
SELECT page_id, regexp_extract(url,'^[a-z]+://([^/?#:]*)',1) AS host FROM pages
WHERE NOT regexp_matches(regexp_extract(url,'^[a-z]+://([^/?#:]*)',1),'(^|\\.)example\\.net$')""")
def f9(t: Tables):
    host = L.url_host(F.col("url"))
    return t.table("pages").select("page_id", host.alias("host")).filter(
        ~L.is_blocked_host(F.col("host"), [*vocab.BLOCKED_HOSTS, "example.net"]))


@query("f10_recency", """
SELECT id, last_distributed_date, coalesce(last_distributed_date > DATE '1998-06-01' - INTERVAL 90 DAY, false) AS hidden,
 coalesce(last_distributed_date < DATE '1998-06-01' - INTERVAL 180 DAY, false) AS due FROM master""")
def f10(t: Tables):
    on, last = date(1998, 6, 1), F.col("last_distributed_date")
    return t.master.select("id", "last_distributed_date", L.served_recently(last, on).alias("hidden"), L.due_again(last, on).alias("due"))


@query("f11_has_no_name", """
SELECT building_id AS id FROM buildings WHERE building_id % 5 IN (0,1,2)""")
def f11(t: Tables):
    from meguri.functions.names import is_unnamed
    k = F.col("building_id") % 5
    name = F.when(k == 0, F.lit(None)).when(k == 1, "　 ").when(k == 2, vocab.UNKNOWN_NAME).when(k == 3, vocab.BLANK_NAME).otherwise(F.col("building_name"))
    return t.buildings.withColumn("n", name).filter(is_unnamed(F.col("n"))).select(F.col("building_id").alias("id"))


for _sort, _order in {
    "address_asc": "normalized_address, building_name", "address_desc": "normalized_address DESC, building_name DESC",
    "name_asc": "building_name, normalized_address", "name_desc": "building_name DESC, normalized_address",
    "units_desc": "total_units DESC NULLS LAST, normalized_address", "units_asc": "total_units ASC NULLS LAST, normalized_address",
}.items():
    @query(f"o1_sort_{_sort}", f"""
WITH s AS (SELECT id, normalized_address, building_name, total_units, row_number() OVER (ORDER BY {_order}, id) AS position FROM master)
SELECT id, position FROM s""")
    def o1(t: Tables, sort=_sort):
        """The position of every row in the order."""
        return L.positions(t.master, sort).select("id", "position")


@query("o2_list_page", """
SELECT id, city, total_units, normalized_address, building_name FROM master
WHERE status = 'NOT_DISTRIBUTED' AND (total_units >= 6 OR total_units IS NULL)
ORDER BY normalized_address, building_name, id LIMIT 100 OFFSET 100""")
def o2(t: Tables):
    return L.list_page(t.master, L.BuildingFilter(page=2)).select(*_BASIC)


@query("o2_page_totals", """
SELECT count(*) AS total, 2 AS page, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS page_count FROM master
WHERE status = 'NOT_DISTRIBUTED' AND (total_units >= 6 OR total_units IS NULL)""")
def o2_totals(t: Tables):
    return L.page_totals(t.master, L.BuildingFilter(page=2))


@query("o3_building_history", "SELECT history_id, distributed_date FROM history WHERE building_id = 899")
def o3(t: Tables):
    rows = t.history.withColumnRenamed("history_id", "id")
    return L.building_history(rows, 899).select(F.col("id").alias("history_id"), "distributed_date")


@query("a1_history_rollup", "SELECT id, distribution_count, last_distributed_date, status FROM master")
def a1(t: Tables):
    return A.refresh_buildings(t.unserved_master, t.stored_history, t.candidates).select(
        "id", "distribution_count", "last_distributed_date", "status")


@query("a2_pending_counts", """
SELECT m.id, (SELECT count(*) FROM pairs p WHERE p.new_building_id = m.id AND p.status = 'pending') AS pending_duplicate_count FROM master m""")
def a2(t: Tables):
    return A.with_pending_counts(t.master, t.candidates).select("id", "pending_duplicate_count")


@query("a3_status_counts", """
WITH s(status) AS (VALUES ('NOT_DISTRIBUTED'),('POSSIBLE_DUPLICATE'),('CONFIRMED_DISTRIBUTED'))
SELECT s.status, count(m.id) AS count FROM s LEFT JOIN (SELECT * FROM master WHERE city = 'NATIONB区'
 AND (total_units >= 6 OR total_units IS NULL)) m ON m.status = s.status GROUP BY s.status""")
def a3(t: Tables):
    return A.status_counts(t.master, L.common_condition(L.BuildingFilter(city="NATIONB区")))


@query("a4_area_options", """
SELECT DISTINCT 'prefecture' AS level, prefecture AS name FROM master
UNION SELECT DISTINCT 'city', city FROM master WHERE prefecture = 'AFR県'
UNION SELECT DISTINCT 'town', town FROM master WHERE prefecture = 'AFR県' AND city = 'NATIONBA区'
UNION SELECT 'prefecture', '東京都'""")
def a4(t: Tables):
    return A.area_options(t.master, "AFR県", "NATIONBA区")


@query("a4_towns_of_city", "SELECT DISTINCT town FROM master WHERE prefecture = 'AME県' AND city = 'NATIONB区'")
def a4_towns(t: Tables):
    return A.towns_of_city(t.master, "AME県", "NATIONB区")


@query("a5_synced_count", "SELECT count(*) AS count FROM master WHERE city = 'NATIONB区' AND source = 'data_source'")
def a5(t: Tables):
    return A.synced_count(t.master, "AME県", "NATIONB区")


@query("a6_area_summary", "SELECT prefecture, city, count(*) AS count FROM buildings GROUP BY 1, 2")
def a6(t: Tables):
    return A.area_summary(t.buildings)


@query("a11_provenance", """
SELECT CASE WHEN source_ref LIKE 'osm:%' THEN 'OSM' WHEN source_ref LIKE 'mock-arakawa:%' THEN '開発用モック（残存＝異常）'
 WHEN source_ref LIKE 'mock:%' THEN '開発用モック新形式（残存＝異常）' WHEN source_ref LIKE 'csv:%' THEN 'CSV'
 WHEN source_ref IS NULL THEN '手入力・過去配布リスト' ELSE 'その他' END AS origin, status, count(*) AS count FROM master GROUP BY 1, 2""")
def a11(t: Tables):
    return A.provenance_by_status(t.master)


@query("a12_coalesced_counts", "SELECT coalesce(building_type,'（未設定）') AS building_type, count(*) AS count FROM master GROUP BY 1")
def a12(t: Tables):
    return A.coalesced_counts(t.master, "building_type", "（未設定）")


@query("a13_bounding_box", """
SELECT min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east, count(*) AS points FROM points""")
def a13(t: Tables):
    return A.bounding_box(t.points)


@query("a14_grouped_messages", """
SELECT message, count(*) AS count, concat(message,'（',CAST(count(*) AS VARCHAR),' 件）') AS text
FROM (SELECT concat('更新に失敗: ',event_type) AS message FROM events WHERE value < 5) GROUP BY message""")
def a14(t: Tables):
    failed = t.table("events").filter("value < 5").select(F.concat(F.lit("更新に失敗: "), "event_type").alias("message"))
    return A.grouped_messages(failed)


@query("a17_table_counts", "SELECT (SELECT count(*) FROM buildings) AS buildings, (SELECT count(*) FROM history) AS history")
def a17(t: Tables):
    return A.table_counts(buildings=t.buildings, history=t.history)


@query("u1_union_datasets", """
SELECT building_name, address, total_units FROM buildings UNION ALL SELECT building_name, address, NULL FROM past_list""")
def u1(t: Tables):
    return U.union_datasets(
        t.buildings.select("building_name", "address", "total_units"), t.past_list.select("building_name", "address"))


@query("u2_first_wins", """
SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""")
def u2(t: Tables):
    return U.first_wins(t.table("events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("u3_first_wins_with_source", """
SELECT source_ref, address, building_name FROM (SELECT *, row_number() OVER (PARTITION BY source_ref, address, building_name ORDER BY copy, building_id) AS rn
 FROM (SELECT *, 1 AS copy FROM buildings UNION ALL SELECT *, 2 FROM buildings)) WHERE rn = 1""")
def u3(t: Tables):
    twice = t.buildings.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return U.first_wins(twice, ["source_ref", "address", "building_name"], ["copy", "building_id"]).select(
        "source_ref", "address", "building_name")


@query("u5_merge_areas", """
SELECT prefecture, city, array_to_string(list_sort(list(DISTINCT town)),'|') AS towns FROM buildings GROUP BY 1, 2""")
def u5(t: Tables):
    listed = t.buildings.select("prefecture", "city", F.array("town").alias("towns"))
    return U.merge_areas(listed, listed.limit(0)).withColumn("towns", F.array_join("towns", "|"))


@query("u6_unique_key_violations", """
SELECT building_id AS id, first_id FROM (SELECT building_id, min(building_id) OVER (PARTITION BY city, town, total_units) AS first_id FROM buildings)
WHERE building_id > first_id""")
def u6(t: Tables):
    """Key (city/town, units) stands in for (address, name), which never repeats here."""
    keyed = t.buildings.select(
        F.col("building_id").alias("id"), F.concat("city", "town").alias("normalized_address"),
        F.coalesce(F.col("total_units").cast("string"), F.lit("-")).alias("normalized_building_name"))
    return U.unique_key_violations(keyed).select("id", "first_id")


@query("u7_expand_coverage", """
SELECT DISTINCT prefecture, city FROM buildings""")
def u7(t: Tables):
    """Prefecture-wide declarations expanded by the area master of the data itself."""
    pairs = t.buildings.select("prefecture", "city").distinct()
    wide = pairs.select("prefecture").distinct()
    return U.expand_coverage(wide.withColumn("city", F.lit(None).cast("string")), pairs)


@query("w4_first_line", """
SELECT event_id AS line, min(event_id) OVER (PARTITION BY user_id) AS first_line FROM events""")
def w4(t: Tables):
    lines = t.table("events").select(F.col("event_id").alias("line"), F.col("user_id").cast("string").alias("building_id"))
    return U.first_line(lines, "building_id").select("line", "first_line")


@query("w5_reject_samples", "SELECT building_id AS row_no FROM buildings WHERE total_units < 3 ORDER BY building_id LIMIT 20")
def w5(t: Tables):
    return U.reject_samples(t.buildings.filter("total_units < 3").select(F.col("building_id").alias("row_no")))


@query("p22_development_rows", "SELECT id, source_ref FROM master WHERE regexp_matches(source_ref,'^mock[-:]')")
def p22(t: Tables):
    return t.master.filter(parse.is_development(F.col("source_ref"))).select("id", "source_ref")


@query("j14_pending_pairs", """
SELECT p.id, p.address_similarity_score, n.building_name AS new_name, e.building_name AS existing_name FROM pairs p
LEFT JOIN master n ON p.new_building_id = n.id LEFT JOIN master e ON p.possible_existing_building_id = e.id
WHERE p.status = 'pending'""")
def j14(t: Tables):
    return J.pending_pairs(t.candidates, t.master).select(
        "id", "address_similarity_score", F.col("new_building.building_name").alias("new_name"),
        F.col("existing_building.building_name").alias("existing_name"))


@query("j15_resolved_pairs", """
SELECT p.id, p.status, n.building_name AS new_name, e.building_name AS existing_name FROM pairs p
LEFT JOIN master n ON p.new_building_id = n.id LEFT JOIN master e ON p.possible_existing_building_id = e.id
WHERE p.status <> 'pending'""")
def j15(t: Tables):
    return J.resolved_pairs(t.candidates, t.master).select(
        "id", "status", F.col("new_building.building_name").alias("new_name"),
        F.col("existing_building.building_name").alias("existing_name"))


@query("j17_unjudged_pairs", """
SELECT CAST(b.building_id AS VARCHAR) AS new_building_id, CAST(b.building_id - k AS VARCHAR) AS possible_existing_building_id FROM buildings b, (VALUES (1), (2)) v(k)
WHERE b.building_id >= k AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.new_building_id = CAST(b.building_id AS VARCHAR)
 AND p.possible_existing_building_id = CAST(b.building_id - k AS VARCHAR))""")
def j17(t: Tables):
    found = t.buildings.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).filter("building_id >= k").select(
        F.col("building_id").cast("string").alias("new_building_id"),
        (F.col("building_id") - F.col("k")).cast("string").alias("possible_existing_building_id"))
    return J.unjudged_pairs(found, t.candidates)


@query("j18_comparison_scope", """
WITH batch AS (SELECT * FROM master WHERE CAST(id AS BIGINT) % 50 = 0)
SELECT m.id FROM master m WHERE m.normalized_address IN (SELECT normalized_address FROM batch)
 OR m.normalized_building_name IN (SELECT normalized_building_name FROM batch)
 OR m.source_ref IN (SELECT source_ref FROM batch)""")
def j18(t: Tables):
    batch = t.master.filter(F.col("id").cast("long") % 50 == 0).select(
        "normalized_address", F.col("normalized_building_name").alias("name_key"), "source_ref", F.lit(None).cast("string").alias("city"))
    return J.comparison_scope(t.master, batch).select("id")


@query("j19_release_stranded", """
SELECT id, CASE WHEN status = 'NOT_DISTRIBUTED' AND CAST(id AS BIGINT) % 10 = 3 THEN 'NOT_DISTRIBUTED' ELSE status END AS status FROM master""")
def j19(t: Tables):
    """Every tenth unserved building is set aside without a waiting pair; the repair frees it."""
    stuck = (F.col("id").cast("long") % 10 == 3) & (F.col("status") == vocab.NOT_DISTRIBUTED)
    marked = t.master.withColumn("status", F.when(stuck, vocab.POSSIBLE).otherwise(F.col("status")))
    return J.release_stranded(marked, t.candidates).select("id", "status")


@query("j19_requarantine", "SELECT id, status FROM master")
def j19_back(t: Tables):
    """Buildings with a waiting pair put back on the list are set aside again."""
    freed = t.master.withColumn("status", F.when(F.col("status") == vocab.POSSIBLE, vocab.NOT_DISTRIBUTED).otherwise(F.col("status")))
    return J.requarantine(freed, t.candidates).select("id", "status")


@query("j20_enrich_units", """
SELECT b.building_id AS id, coalesce(b.total_units, u.n) AS total_units FROM buildings b
LEFT JOIN (SELECT o_custkey, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1) u ON b.building_id = u.o_custkey""")
def j20(t: Tables):
    units = t.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("int").alias("total_units"))
    return J.enrich_units(t.buildings.select(F.col("building_id").alias("id"), "total_units"), units)
