"""Queries: scalar functions run as column jobs, and string-pair similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from meguri.catalog.base import Tables, query, sql_jaro_winkler, sql_metres, sql_name_score, sql_normal_address, sql_normal_name
from meguri.functions import address as P
from meguri.functions import geo, names, osm, parse, similarity, use, vocab
from meguri.operators import aggregates as A
from meguri.operators import joins as J

# The address of every building in five spellings.
_SPELLINGS = """
SELECT building_id, 1 AS k, address AS spelling FROM buildings
UNION ALL SELECT building_id, 2, concat(prefecture,' ',city,town,translate(CAST(chome AS STRING),'0123456789','０１２３４５６７８９'),'丁目',CAST(block AS STRING),'番',CAST(house AS STRING),'号') FROM buildings
UNION ALL SELECT building_id, 3, concat(city,'　',town,CAST(chome AS STRING),'－',CAST(block AS STRING),'ー',CAST(house AS STRING)) FROM buildings
UNION ALL SELECT building_id, 4, concat(prefecture,city,town,substr('一二三四五六',chome,1),'丁目',CAST(block AS STRING),'番地',CAST(house AS STRING)) FROM buildings
UNION ALL SELECT building_id, 5, concat(address,' ',building_name) FROM buildings
"""


def _spellings(t: Tables):
    return t.spark.sql(_SPELLINGS.replace("FROM buildings", "FROM {b}"), b=t.buildings)


_PLAIN = "concat(lower(b.city),lower(b.town),CAST(b.chome AS VARCHAR),'-',CAST(b.block AS VARCHAR),'-',CAST(b.house AS VARCHAR))"


@query("p1_normalized_address", f"""
WITH s AS ({_SPELLINGS}) SELECT s.building_id, s.k, {_PLAIN} AS normalized,
 CASE WHEN s.k = 5 THEN replace(lower(b.building_name),'#','') ELSE '' END AS extra,
 concat(lower(b.city),lower(b.town)) AS locality,
 concat(CAST(b.chome AS VARCHAR),'-',CAST(b.block AS VARCHAR),'-',CAST(b.house AS VARCHAR)) AS blocks,
 CASE WHEN s.k IN (2,4) THEN b.prefecture END AS prefecture
FROM s JOIN buildings b ON s.building_id = b.building_id""")
def p1(t: Tables):
    done = P.with_address(_spellings(t), "spelling", "a")
    return done.select("building_id", "k", "a.normalized", "a.extra", "a.locality",
                       F.array_join("a.blocks", "-").alias("blocks"), "a.prefecture")


@query("p2_address_parts", f"""
WITH s AS ({_SPELLINGS}) SELECT s.building_id, s.k, CASE WHEN s.k IN (2,4) THEN b.prefecture END AS prefecture, b.city, b.town
FROM s JOIN buildings b ON s.building_id = b.building_id""")
def p2(t: Tables):
    done = _spellings(t).withColumn("a", P.address_parts(F.col("spelling")))
    return done.select("building_id", "k", "a.prefecture", "a.city", "a.town")


@query("p3_prefecture_backfill", """
SELECT b.building_id, b.city, CASE WHEN b.building_id % 2 = 0 THEN b.prefecture ELSE one.prefecture END AS prefecture
FROM buildings b LEFT JOIN (SELECT city, min(prefecture) AS prefecture FROM
 (SELECT city, CASE WHEN building_id % 1000 = 0 THEN 'X県' ELSE prefecture END AS prefecture FROM buildings)
 GROUP BY city HAVING count(DISTINCT prefecture) = 1) one ON b.city = one.city""")
def p3(t: Tables):
    """The area master is read off the data; a city under two prefectures fills nothing."""
    owner = F.when(F.col("building_id") % 1000 == 0, "X県").otherwise(F.col("prefecture"))
    areas = t.buildings.select(owner.alias("prefecture"), "city")
    known = F.when(F.col("building_id") % 2 == 0, F.col("prefecture"))
    return P.with_prefecture_from(t.buildings.withColumn("prefecture", known), areas).select("building_id", "city", "prefecture")


@query("p4_block_key", f"""
WITH s AS ({_SPELLINGS}) SELECT s.building_id, s.k, concat_ws('/',b.city,b.town,CAST(b.chome AS VARCHAR),CAST(b.block AS VARCHAR)) AS block_key
FROM s JOIN buildings b ON s.building_id = b.building_id""")
def p4(t: Tables):
    return _spellings(t).select("building_id", "k", P.block_key_text(F.col("spelling")).alias("block_key"))


@query("p5_canonical_address", f"""
WITH s AS ({_SPELLINGS}) SELECT s.building_id, s.k,
 concat(b.city,b.town,CAST(b.chome AS VARCHAR),'-',CAST(b.block AS VARCHAR),'-',CAST(b.house AS VARCHAR),CASE WHEN s.k = 5 THEN b.building_name ELSE '' END) AS canonical
FROM s JOIN buildings b ON s.building_id = b.building_id""")
def p5(t: Tables):
    return _spellings(t).select("building_id", "k", P.canonical_address(F.col("spelling")).alias("canonical"))


@query("p26_city_of_address", f"""
WITH s AS ({_SPELLINGS}) SELECT s.building_id, s.k, b.city FROM s JOIN buildings b ON s.building_id = b.building_id""")
def p26(t: Tables):
    return _spellings(t).select("building_id", "k", P.city_of(F.col("spelling")).alias("city"))


@query("p6_normalized_name", f"SELECT building_id, {sql_normal_name('name')} AS normalized FROM names")
def p6(t: Tables):
    return t.names.select("building_id", names.normalize_name(F.col("name")).alias("normalized"))


_W1 = "['grand','royal','sun','green']"
_W2 = "['maison','court','heights','park']"


@query("p7_name_tokens", f"""
SELECT building_id, concat_ws(' ',{_W1}[w1+1],{_W2}[w2+1],CAST(building_id % 50 AS VARCHAR)) AS tokens,
 concat({_W1}[w1+1],{_W2}[w2+1],CAST(building_id % 50 AS VARCHAR)) AS canonical FROM names""")
def p7(t: Tables):
    done = names.with_name(t.names, "name", "f")
    return done.select("building_id", F.array_join("f.tokens", " ").alias("tokens"), "f.canonical")


@query("p8_romanized_names", """
SELECT building_id, replace(replace(replace(CASE WHEN building_id % 2 = 0
  THEN concat(['gurando','','san',''][w1+1],['mezon','koto','haitu','paku'][w2+1],CAST(building_id % 50 AS VARCHAR))
  ELSE concat(['','royar','','gren'][w1+1],['maison','kort','heights','park'][w2+1],CAST(building_id % 50 AS VARCHAR)) END,
 'nm','m'),'np','mp'),'ts','t') AS romaji FROM names""")
def p8(t: Tables):
    return t.names.select("building_id", names.romanize(names.normalize_name(F.col("name"))).alias("romaji"))


_USE_CASES = """
SELECT building_id, CASE building_id % 10 WHEN 0 THEN 'apartments' WHEN 1 THEN 'House' WHEN 2 THEN '店舗付きマンション' WHEN 3 THEN 'residential'
 WHEN 4 THEN 'yes' WHEN 5 THEN '倉庫' WHEN 6 THEN 'その他' WHEN 7 THEN '' WHEN 8 THEN NULL ELSE '共同住宅' END AS use_value,
 CASE WHEN building_id % 3 = 0 THEN concat('荒川メゾン',CAST(building_id AS STRING)) ELSE concat('山田ビル',CAST(building_id AS STRING)) END AS name FROM buildings
"""


@query("p9_use_classification", f"""
WITH c AS ({_USE_CASES}), d AS (SELECT *, building_id % 10 AS k, building_id % 3 = 0 AS named FROM c)
SELECT building_id, CASE WHEN k IN (0,9) OR (k IN (3,4,6,7,8) AND named) THEN 'RESIDENTIAL_MULTI' ELSE 'EXCLUDED' END AS use,
 CASE k WHEN 0 THEN 'apartments' WHEN 1 THEN 'house' WHEN 2 THEN '店舗付き' WHEN 5 THEN '倉庫' WHEN 9 THEN '共同住宅'
  ELSE CASE WHEN named THEN 'メゾン' WHEN k IN (3,4,6) THEN use_value ELSE NULL END END AS term,
 CASE k WHEN 0 THEN 'residential_multi' WHEN 1 THEN 'single_dwelling' WHEN 2 THEN 'commercial' WHEN 5 THEN 'industrial' WHEN 9 THEN 'residential_multi'
  ELSE CASE WHEN named THEN 'residential_multi' ELSE 'ambiguous' END END AS category,
 k IN (3,4,6,7,8) AND NOT named AS unknown FROM d""")
def p9(t: Tables):
    rows = t.spark.sql(_USE_CASES.replace("FROM buildings", "FROM {b}"), b=t.buildings)
    return use.with_use(rows, "use_value", "name", "u").select("building_id", "u.use", "u.term", "u.category", "u.unknown")


_TYPES = """
SELECT building_id, CASE building_id % 9 WHEN 0 THEN '賃貸マンション' WHEN 1 THEN '分譲' WHEN 2 THEN 'Rental' WHEN 3 THEN '持家' WHEN 4 THEN '賃'
 WHEN 5 THEN '賃貸・分譲' WHEN 6 THEN '不明' WHEN 7 THEN '' ELSE 'マンション' END AS v FROM buildings
"""


def _types(t: Tables):
    return t.spark.sql(_TYPES.replace("FROM buildings", "FROM {b}"), b=t.buildings)


@query("p10_property_type_of_source", f"""
WITH c AS ({_TYPES}) SELECT building_id, CASE WHEN v LIKE '%賃貸%' OR lower(v) LIKE '%rent%' THEN 'rental' WHEN v LIKE '%分譲%' THEN 'condominium' ELSE 'unknown' END AS property_type FROM c""")
def p10(t: Tables):
    return _types(t).select("building_id", parse.property_type_of_source(F.col("v")).alias("property_type"))


@query("p11_property_type_of_import", f"""
WITH c AS ({_TYPES}) SELECT building_id, CASE WHEN v LIKE '%賃%' OR lower(v) LIKE '%rental%' THEN 'rental' WHEN v LIKE '%分譲%' OR v LIKE '%持家%' THEN 'condominium' ELSE 'unknown' END AS property_type FROM c""")
def p11(t: Tables):
    return _types(t).select("building_id", parse.property_type_of_import(F.col("v")).alias("property_type"))


@query("p12_property_type_of_research", f"""
WITH c AS ({_TYPES}) SELECT building_id, CASE building_id % 9 WHEN 0 THEN 'rental' WHEN 1 THEN 'condominium' WHEN 2 THEN 'rental' WHEN 6 THEN 'unknown' END AS value,
 building_id % 9 IN (3,4,5,8) AS is_error FROM c""")
def p12(t: Tables):
    done = _types(t).withColumn("r", parse.property_type_of_research(F.col("v")))
    return done.select("building_id", "r.value", F.col("r.error").isNotNull().alias("is_error"))


_UNITS = """
SELECT building_id, CASE building_id % 7 WHEN 0 THEN concat('1,',lpad(CAST(building_id % 1000 AS STRING),3,'0'),'戸') WHEN 1 THEN '不明' WHEN 2 THEN ''
 WHEN 3 THEN concat('約',translate(CAST(building_id % 90 AS STRING),'0123456789','０１２３４５６７８９')) WHEN 4 THEN '-5' WHEN 5 THEN CAST(building_id % 90 AS STRING)
 ELSE concat(CAST(building_id % 90 AS STRING),'世帯/2棟') END AS v FROM buildings
"""


def _units(t: Tables):
    return t.spark.sql(_UNITS.replace("FROM buildings", "FROM {b}"), b=t.buildings)


@query("p13_units_of_source", f"""
WITH c AS ({_UNITS}) SELECT building_id, CASE WHEN n >= 0 THEN CAST(floor(n) AS INT) END AS units
FROM (SELECT building_id, TRY_CAST(regexp_replace(v,'[^0-9.-]','','g') AS DOUBLE) AS n FROM c)""")
def p13(t: Tables):
    return _units(t).select("building_id", parse.count_of_source(F.col("v")).alias("units"))


@query("p14_units_of_import", f"""
WITH c AS ({_UNITS}) SELECT building_id, TRY_CAST(regexp_extract(translate(v,'０１２３４５６７８９','0123456789'),'[0-9]+') AS INT) AS units FROM c""")
def p14(t: Tables):
    return _units(t).select("building_id", parse.count_of_import(F.col("v")).alias("units"))


@query("p15_units_of_research", f"""
WITH c AS ({_UNITS}) SELECT building_id, CASE WHEN regexp_full_match(v,'[0-9]+') AND CAST(v AS INT) > 0 THEN CAST(v AS INT) END AS value,
 NOT (v = '' OR (regexp_full_match(v,'[0-9]+') AND CAST(v AS INT) > 0)) AS is_error FROM
 (SELECT building_id, CASE WHEN regexp_full_match(v,'[0-9]+') THEN v ELSE CASE WHEN v = '' THEN '' ELSE 'x' END END AS v FROM c)""".replace(
    "CAST(v AS INT)", "TRY_CAST(v AS INT)"))
def p15(t: Tables):
    done = _units(t).withColumn("r", parse.count_of_research(F.col("v")))
    return done.select("building_id", "r.value", F.col("r.error").isNotNull().alias("is_error"))


@query("p16_coordinates", """
SELECT p_partkey AS point_id, CASE WHEN x BETWEEN -90 AND 90 THEN x END AS latitude, CASE WHEN y BETWEEN -180 AND 180 THEN y END AS longitude
FROM (SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size * 4 AS VARCHAR) END AS DOUBLE) AS x, CAST(p_size * 8 AS DOUBLE) AS y FROM part)""")
def p16(t: Tables):
    lat = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise((F.col("p_size") * 4).cast("string"))
    return t.table("part").select(
        F.col("p_partkey").alias("point_id"), parse.coordinate(lat, "latitude").alias("latitude"),
        parse.coordinate((F.col("p_size") * 8).cast("string"), "longitude").alias("longitude"))


@query("p17_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS on_date FROM orders""")
def p17(t: Tables):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    wide = F.translate(F.date_format(d, "yyyy年M月d日"), "0123456789", "０１２３４５６７８９")
    text = F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, wide).when(
        k == 3, F.date_format(d, "'配布日 'yyyy.M.d")).otherwise("来月上旬")
    return t.table("orders").select("o_orderkey", parse.date_of_import(text).alias("on_date"))


@query("p18_research_source", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'google_maps' WHEN 'view' THEN 'chatgpt' WHEN 'purchase' THEN 'homes' END AS value,
 event_type NOT IN ('click','view','purchase') AS is_error FROM events""")
def p18(t: Tables):
    kind = F.col("event_type")
    text = F.when(kind == "click", " Google-Maps").when(kind == "view", "ChatGPT ").when(kind == "purchase", "homes").when(kind == "error", "").otherwise("ブログ")
    done = t.table("events").select("event_id", parse.research_source(text).alias("r"))
    return done.select("event_id", "r.value", F.col("r.error").isNotNull().alias("is_error"))


@query("p21_distance", f"""
SELECT a.building_id, round({sql_metres('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 3) AS metres
FROM buildings a LEFT JOIN buildings b ON b.building_id = a.building_id + 1""")
def p21(t: Tables):
    b = t.buildings.select((F.col("building_id") - 1).alias("building_id"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    m = geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    return t.buildings.join(b, "building_id", "left").select("building_id", F.round(m, 3).alias("metres"))


@query("p23_stored_name_key", """
SELECT building_id, CASE WHEN building_id % 2 = 0 AND source_ref IS NOT NULL THEN concat('建物名不明#',source_ref)
 WHEN building_id % 2 = 0 THEN '建物名不明' ELSE replace(lower(building_name),'#','') END AS name_key FROM buildings""")
def p23(t: Tables):
    name = F.when(F.col("building_id") % 2 == 0, vocab.UNKNOWN_NAME).otherwise(F.col("building_name"))
    return t.buildings.select("building_id", names.stored_name_key(name, F.col("source_ref")).alias("name_key"))


@query("p24_dataset_id", """
SELECT page_id, CASE WHEN d = '' THEN 'dataset' ELSE d END AS dataset FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(url,'^.*/',''),'\\.[^.]+$',''),'[^\\p{L}\\p{N}_-]+','-','g'),'^-+|-+$','','g') AS d FROM pages)""")
def p24(t: Tables):
    return t.table("pages").select("page_id", parse.dataset_id(F.col("url")).alias("dataset"))


@query("p25_percent_text", """
SELECT l_orderkey, l_linenumber, l_partkey, concat(CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS VARCHAR),'%') AS share FROM lineitem""")
def p25(t: Tables):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parse.percent_text(F.col("l_discount")).alias("share"))


# -- pairs ----------------------------------------------------------------------
def _pairs(t: Tables):
    n = names.with_name(t.names, "name", "f").select("building_id", "f")
    m = n.select((F.col("building_id") - 4).alias("building_id"), F.col("f").alias("g"))
    return n.join(m, "building_id")


_LISTED = f"SELECT building_id, {_W1}[w1+1] AS c1, {_W2}[w2+1] AS c2, CAST(building_id % 50 AS VARCHAR) AS c3, concat({_W1}[w1+1],{_W2}[w2+1],CAST(building_id % 50 AS VARCHAR)) AS c FROM names"


@query("n2_levenshtein", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, levenshtein(a.c, b.c) AS distance,
 (greatest(length(a.c),length(b.c)) - levenshtein(a.c,b.c)) / greatest(length(a.c),length(b.c)) AS ratio FROM n a JOIN n b ON b.building_id = a.building_id + 4""")
def n2(t: Tables):
    x, y = F.col("f.canonical"), F.col("g.canonical")
    return _pairs(t).select("building_id", F.levenshtein(x, y).cast("long").alias("distance"), similarity.levenshtein_ratio(x, y).alias("ratio"))


@query("n3_bigram_dice", f"""
WITH n AS ({_LISTED}), g AS (SELECT building_id, length(c)-1 AS size, substr(c,i,2) AS gram, count(*) AS n FROM
 (SELECT building_id, c, unnest(range(1,length(c))) AS i FROM n) GROUP BY building_id, c, substr(c,i,2))
SELECT a.building_id, max(2.0 * coalesce(o.hits,0) / (length(a.c)-1 + length(b.c)-1)) AS dice FROM n a JOIN n b ON b.building_id = a.building_id + 4
LEFT JOIN (SELECT x.building_id, CAST(sum(least(x.n,y.n)) AS DOUBLE) AS hits FROM g x JOIN g y ON y.building_id = x.building_id + 4 AND x.gram = y.gram GROUP BY 1) o
 ON o.building_id = a.building_id GROUP BY a.building_id""")
def n3(t: Tables):
    return _pairs(t).select("building_id", similarity.bigram_dice(F.col("f.canonical"), F.col("g.canonical")).alias("dice"))


@query("n4_jaro_winkler", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, {sql_jaro_winkler('a.c', 'b.c')} AS score FROM n a JOIN n b ON b.building_id = a.building_id + 4""")
def n4(t: Tables):
    return _pairs(t).select("building_id", similarity.jaro_winkler(F.col("f.canonical"), F.col("g.canonical")).alias("score"))


@query("n5_token_dice", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, 2.0 * ((CASE WHEN a.c1 = b.c1 THEN 1 ELSE 0 END) + (CASE WHEN a.c2 = b.c2 THEN 1 ELSE 0 END)
 + (CASE WHEN a.c3 = b.c3 THEN 1 ELSE 0 END)) / 6.0 AS dice FROM n a JOIN n b ON b.building_id = a.building_id + 4""".replace("2.0 *", "CAST(2.0 AS DOUBLE) *"))
def n5(t: Tables):
    return _pairs(t).select("building_id", similarity.token_dice(F.col("f.tokens"), F.col("g.tokens")).alias("dice"))


@query("n6_token_prefix", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, a.c1 = b.c1 AND a.c2 = b.c2 AS is_prefix FROM n a JOIN n b ON b.building_id = a.building_id + 4""")
def n6(t: Tables):
    short = F.slice("f.tokens", 1, 2)
    return _pairs(t).select("building_id", similarity.is_token_prefix(short, F.col("g.tokens")).alias("is_prefix"))


@query("n1_name_similarity", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, {sql_name_score('a.c', 'b.c')} AS score, false AS token_exact, false AS translit
FROM n a JOIN n b ON b.building_id = a.building_id + 4""")
def n1(t: Tables):
    done = _pairs(t).withColumn("s", similarity.name_similarity(F.col("f"), F.col("g")))
    return done.select("building_id", "s.score", "s.token_exact", "s.translit")


@query("n1_same_name_in_two_scripts", f"""
WITH n AS ({_LISTED}) SELECT a.building_id, b.building_id AS other_id, 1.0::DOUBLE AS score FROM n a JOIN n b ON a.c = b.c AND a.building_id < b.building_id""")
def n1_same(t: Tables):
    named = names.with_name(t.names, "name", "f").select("building_id", "f")
    return J.same_name_pairs(named, lambda f, g: similarity.name_similarity(f, g)["score"])


@query("j7_address_similarity", """
WITH p AS (SELECT a.building_id, lower(concat(a.city,a.town)) AS la, lower(concat(b.city,b.town)) AS lb, a.chome AS a1, a.block AS a2, a.house AS a3,
 b.chome AS b1, b.block AS b2, b.house AS b3 FROM buildings a JOIN buildings b ON b.building_id = a.building_id + 120),
q AS (SELECT *, CASE WHEN a1 <> b1 THEN 0 WHEN a2 <> b2 THEN 1 WHEN a3 <> b3 THEN 2 ELSE 3 END AS d,
 (greatest(length(la),length(lb)) - levenshtein(replace(la,'区','#'),replace(lb,'区','#'))) / greatest(length(la),length(lb)) AS r FROM p)
SELECT building_id, floor((CASE WHEN la <> lb THEN r * 0.5 WHEN d = 3 THEN 1.0 ELSE 0.45 + 0.25 * d / 3 END) * 10000 + 0.5) / 10000 AS score,
 la = lb AS locality_match, CASE WHEN d = 3 THEN 'equal' ELSE 'divergent' END AS relation, d AS depth FROM q""")
def j7(t: Tables):
    a = P.with_address(t.buildings, "address", "a").select("building_id", "a")
    b = a.select((F.col("building_id") - 120).alias("building_id"), F.col("a").alias("b"))
    done = a.join(b, "building_id").withColumn("s", similarity.address_similarity(F.col("a"), F.col("b")))
    return done.select("building_id", "s.score", "s.locality_match", "s.relation", "s.depth")


# -- map elements ---------------------------------------------------------------
_ELEMENTS = """
SELECT building_id, CASE building_id % 12 WHEN 0 THEN 'house' WHEN 1 THEN 'housing' WHEN 2 THEN 'Housing' ELSE 'apartments' END AS building,
 CASE WHEN building_id % 12 = 3 THEN 'yes' END AS shop, CASE building_id % 12 WHEN 4 THEN 'dormitory' WHEN 2 THEN 'apartments' END AS residential,
 CASE building_id % 12 WHEN 5 THEN 'office' WHEN 6 THEN 'residential' END AS building_use,
 CASE WHEN building_id % 12 = 7 THEN '第一社宅' WHEN building_id % 2 = 0 THEN building_name END AS name,
 CASE WHEN building_id % 3 = 0 THEN town END AS suburb, CASE WHEN building_id % 3 = 0 THEN CAST(chome AS STRING) END AS quarter,
 CASE WHEN building_id % 6 = 0 THEN CAST(block AS STRING) END AS block_number, CASE WHEN building_id % 3 = 0 THEN CAST(house AS STRING) END AS housenumber,
 CASE WHEN building_id % 11 = 8 THEN NULL ELSE latitude END AS lat, longitude AS lon, CAST(total_units AS STRING) AS flats FROM buildings
"""


def elements(t: Tables):
    rows = t.spark.sql(_ELEMENTS.replace("FROM buildings", "FROM {b}"), b=t.buildings)
    tags = {"building": "building", "shop": "shop", "residential": "residential", "building:use": "building_use", "name": "name",
            "addr:suburb": "suburb", "addr:quarter": "quarter", "addr:block_number": "block_number",
            "addr:housenumber": "housenumber", "building:flats": "flats"}
    pairs = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in tags.items()]), lambda e: e["v"].isNotNull()))
    return rows.select(F.lit("way").alias("type"), F.col("building_id").alias("id"), "lat", F.when(F.col("lat").isNotNull(), F.col("lon")).alias("lon"),
                       F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), pairs.alias("tags"))


_ADDRESS_SQL = """CASE WHEN suburb IS NULL THEN NULL ELSE concat('東京都荒川区',suburb,quarter,'丁目',
 CASE WHEN block_number IS NULL THEN housenumber ELSE concat(block_number,'-',housenumber) END) END"""
_UNITS_SQL = "CASE WHEN TRY_CAST(flats AS INT) > 0 THEN CAST(flats AS INT) END"
_REASON_SQL = f"""CASE WHEN shop IS NOT NULL OR building_use = 'office' THEN 'mixed_use' WHEN residential = 'dormitory' THEN 'dormitory'
 WHEN lower(building) = 'housing' AND NOT ({_UNITS_SQL} IS NOT NULL OR coalesce(residential,'') = 'apartments') THEN 'not_multi_dwelling'
 WHEN lower(building) NOT IN ('housing','apartments') THEN 'not_multi_dwelling' WHEN name = '第一社宅' THEN 'name_excluded'
 WHEN {_ADDRESS_SQL} IS NULL AND lat IS NULL THEN 'no_address' END"""


@query("p19_address_of_tags", f"WITH e AS ({_ELEMENTS}) SELECT building_id AS id, {_ADDRESS_SQL} AS address FROM e")
def p19(t: Tables):
    return elements(t).select("id", osm.address_of_tags(F.col("tags"), "東京都", "荒川区").alias("address"))


@query("p20_name_and_units_of_tags", f"WITH e AS ({_ELEMENTS}) SELECT building_id AS id, name, {_UNITS_SQL} AS total_units FROM e")
def p20(t: Tables):
    return elements(t).select("id", osm.name_of_tags(F.col("tags")).alias("name"), osm.units_of_tags(F.col("tags")).alias("total_units"))


@query("f7_acceptance", f"""
WITH e AS ({_ELEMENTS}), r AS (SELECT *, {_REASON_SQL} AS reason FROM e)
SELECT building_id AS id, reason IS NULL AS accepted, reason FROM r""")
def f7(t: Tables):
    return osm.convert_elements(elements(t), "東京都", "荒川区").select("id", "accepted", "reason")


@query("a7_conversion_statistics", f"""
WITH e AS ({_ELEMENTS}), r AS (SELECT *, {_REASON_SQL} AS reason, {_ADDRESS_SQL} AS address, {_UNITS_SQL} AS units FROM e)
SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS accepted,
 count(*) FILTER (reason = 'not_multi_dwelling') AS rejected_not_multi_dwelling, count(*) FILTER (reason = 'mixed_use') AS rejected_mixed_use,
 count(*) FILTER (reason = 'dormitory') AS rejected_dormitory, count(*) FILTER (reason = 'name_excluded') AS rejected_name_excluded,
 count(*) FILTER (reason = 'no_address') AS rejected_no_address, count(*) FILTER (reason = 'no_coordinates') AS rejected_no_coordinates,
 count(*) FILTER (reason IS NULL AND name IS NOT NULL) AS with_name, count(*) FILTER (reason IS NULL AND address IS NOT NULL) AS with_address,
 count(*) FILTER (reason IS NULL AND lat IS NOT NULL) AS with_coordinates, count(*) FILTER (reason IS NULL AND units IS NOT NULL) AS with_total_units FROM r""")
def a7(t: Tables):
    return A.conversion_statistics(osm.convert_elements(elements(t), "東京都", "荒川区"))
