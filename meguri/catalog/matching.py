"""Queries: identity joins, duplicate matching, nearest points, name verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from meguri.catalog.base import Tables, query, sql_metres, sql_name_score, sql_normal_address, sql_normal_name
from meguri.functions import vocab
from meguri.functions.address import block_key_text
from meguri.functions.names import with_name
from meguri.functions.similarity import round4
from meguri.operators import aggregates as A
from meguri.operators import joins as J
from meguri.operators import matching as M
from meguri.operators.quality import check_completion_rows, prepare_rows
from meguri.plans import names as N
from meguri.session import settled

# Past rows that agree by address, by name only, or not at all.
_PAST = """
SELECT row_no, CASE WHEN row_no % 3 = 2 THEN '存在しない建物' ELSE building_name END AS building_name,
 CASE WHEN row_no % 3 = 0 THEN address ELSE concat('架空区九番町',CAST(1 + row_no % 9 AS STRING),'-99') END AS address, distributed_date FROM past_list
"""


def past_rows(t: Tables):
    rows = t.spark.sql(_PAST.replace("FROM past_list", "FROM {p}"), p=t.past_list)
    none = F.lit(None).cast("string")
    return rows.select("row_no", "building_name", "address", F.struct(
        "distributed_date", none.alias("distributed_by"), none.alias("notes")).alias("distribution"))


PAST_MATCH_SQL = f"""
past AS ({_PAST}), q AS (SELECT *, {sql_normal_address('address')} AS na, {sql_normal_name('building_name')} AS nn FROM past),
m AS (SELECT q.row_no, q.building_name, q.address, q.distributed_date,
 (SELECT min(id) FROM master b WHERE b.normalized_address = q.na AND b.normalized_building_name = q.nn) AS both_id,
 (SELECT min(id) FROM master b WHERE b.normalized_address = q.na) AS addr_id,
 (SELECT min(id) FROM master b WHERE b.normalized_building_name = q.nn) AS name_id FROM q)"""


@query("j1_past_row_target", f"""WITH {PAST_MATCH_SQL}
SELECT row_no, coalesce(both_id, addr_id, name_id) AS target_id,
 CASE WHEN both_id IS NOT NULL THEN 'address_and_name' WHEN addr_id IS NOT NULL THEN 'address' WHEN name_id IS NOT NULL THEN 'name' END AS match_kind FROM m""")
def j1(t: Tables):
    return J.resolve_past_rows(prepare_rows(past_rows(t)), t.snapshot.buildings).select("row_no", "target_id", "match_kind")


# New rows next to stored buildings: same source id, same name, shifted points, elsewhere.
_NEW = """
SELECT building_id AS row_no, CASE building_id % 5 WHEN 2 THEN '（建物名不明）' WHEN 4 THEN concat('別館',CAST(building_id AS STRING)) ELSE building_name END AS building_name,
 CASE building_id % 5 WHEN 3 THEN concat('架空区桜町',CAST(building_id AS STRING),'-1') WHEN 4 THEN concat('新区松町',CAST(building_id AS STRING),'-2') ELSE address END AS address,
 CAST(total_units AS INT) AS total_units, property_type, 'apartments' AS building_use_raw,
 CASE building_id % 5 WHEN 2 THEN latitude + CAST(0.00002 AS DOUBLE) WHEN 4 THEN latitude + CAST(0.00008 AS DOUBLE) ELSE latitude END AS latitude, longitude,
 CASE building_id % 5 WHEN 0 THEN source_ref ELSE concat('list:',CAST(building_id AS STRING)) END AS source_ref
FROM buildings
"""


def new_rows(t: Tables):
    return t.spark.sql(_NEW.replace("FROM buildings", "FROM {b}"), b=t.buildings)


_LAT_M = "0.0003"


def _sql_new_match() -> str:
    d = sql_metres("n.latitude", "n.longitude", "b.latitude", "b.longitude")
    same = """CASE WHEN n.building_name <> '（建物名不明）' AND b.building_name <> '（建物名不明）' THEN n.nn = b.normalized_building_name
      ELSE n.building_name <> '（建物名不明）' OR b.building_name <> '（建物名不明）' END"""
    return f"""
n AS (SELECT *, {sql_normal_address('address')} AS na,
  CASE WHEN building_name = '（建物名不明）' THEN concat('建物名不明#',source_ref) ELSE {sql_normal_name('building_name')} END AS nn FROM ({_NEW})),
d AS (SELECT n.row_no, b.id, {d} AS m, n.na = b.normalized_address AS here, {same} AS ok FROM n JOIN master b
  ON b.latitude BETWEEN n.latitude - {_LAT_M} AND n.latitude + {_LAT_M} AND b.longitude BETWEEN n.longitude - 0.0006 AND n.longitude + 0.0006),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY m, id) AS rn FROM d WHERE here AND m <= 5) WHERE rn = 1 AND ok),
away AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY m, id) AS rn FROM d WHERE NOT here AND m <= 15) WHERE rn = 1),
r AS (SELECT n.row_no, (SELECT min(id) FROM master b WHERE b.source_ref = n.source_ref) AS by_ref,
  (SELECT min(id) FROM master b WHERE b.normalized_address = n.na AND b.normalized_building_name = n.nn) AS by_both,
  near.id AS by_near, CASE WHEN away.m <= 5 AND away.ok THEN away.id END AS by_away, away.id IS NOT NULL AND NOT (away.m <= 5 AND away.ok) AS is_near
  FROM n LEFT JOIN near USING (row_no) LEFT JOIN away USING (row_no))"""


@query("j2_new_row_identity", f"""WITH {_sql_new_match()}
SELECT row_no, coalesce(by_ref, by_both, by_near, by_away) AS target_id,
 CASE WHEN by_ref IS NOT NULL THEN 'source_ref' WHEN by_both IS NOT NULL THEN 'address_and_name' WHEN by_near IS NOT NULL THEN 'proximity'
  WHEN by_away IS NOT NULL THEN 'coordinates' END AS match_kind,
 coalesce(by_ref, by_both, by_near) IS NULL AND is_near AS is_near_miss FROM r""")
def j2(t: Tables):
    rows = settled(prepare_rows(new_rows(t)))
    done = J.resolve_new_rows(rows, _keyed_master(t))
    return done.select("row_no", "target_id", "match_kind", F.col("near_miss").isNotNull().alias("is_near_miss"))


def _keyed_master(t: Tables):
    keyed = with_name(t.snapshot.buildings, "building_name", "_n").withColumn("canonical", F.col("_n.canonical")).drop("_n")
    return settled(keyed)


@query("j3_proximity", f"""WITH {_sql_new_match()} SELECT row_no, id AS near_id, round(m, 3) AS distance FROM near""")
def j3(t: Tables):
    return J.nearest_same_address(prepare_rows(new_rows(t)), _keyed_master(t)).withColumn("distance", F.round("distance", 3))


@query("j4_coordinates_elsewhere", f"""WITH {_sql_new_match()}
SELECT row_no, id AS near_id, round(m, 3) AS distance, CASE WHEN m <= 5 AND ok THEN 'merge' ELSE 'near' END AS kind FROM away""")
def j4(t: Tables):
    done = J.nearest_elsewhere(prepare_rows(new_rows(t)), _keyed_master(t))
    return done.select("row_no", "near_id", F.round("distance", 3).alias("distance"), "kind")


@query("j5_name_rule", """
SELECT a.building_id, CASE WHEN a.building_id % 3 = 0 AND a.building_id % 5 = 0 THEN false WHEN a.building_id % 3 = 0 OR a.building_id % 5 = 0 THEN true
 ELSE a.w1 = b.w1 AND a.w2 = b.w2 AND a.building_id % 50 = b.building_id % 50 END AS may_be_same FROM names a JOIN names b ON b.building_id = a.building_id + 400""")
def j5(t: Tables):
    unknown = vocab.UNKNOWN_NAME
    n = with_name(t.names, "name", "f").select("building_id", "name", F.col("f.canonical").alias("c"))
    m = n.select((F.col("building_id") - 400).alias("building_id"), F.col("name").alias("name2"), F.col("c").alias("c2"))
    a = F.when(F.col("building_id") % 3 == 0, unknown).otherwise(F.col("name"))
    b = F.when(F.col("building_id") % 5 == 0, unknown).otherwise(F.col("name2"))
    return n.join(m, "building_id").select("building_id", J.same_building_names(a, b, F.col("c"), F.col("c2")).alias("may_be_same"))


def _sides(t: Tables):
    cols = ["id", "building_name", "address", "latitude", "longitude", "normalized_address"]
    stored = t.snapshot.buildings
    targets = stored.filter("distribution_count = 0").select(*cols)
    served = stored.filter("distribution_count > 0").select(*cols)
    return targets, served


def _sql_candidates(targets: str, existing: str) -> str:
    """J6 over every pair of one locality or within 30 m, best five: the names
    here are one word and a number, the addresses three numbers after the locality."""
    side = """SELECT id, building_name, normalized_address AS na, lower(concat(city,town)) AS loc, CAST(1 + CAST(id AS BIGINT) % 6 AS INT) AS b1,
     CAST(1 + CAST(id AS BIGINT) % 40 AS INT) AS b2, CAST(1 + CAST(id AS BIGINT) % 9 AS INT) AS b3, latitude, longitude,
     concat('kustomer',regexp_extract(building_name,'[0-9]+')) AS nm"""
    m = sql_metres("t.latitude", "t.longitude", "e.latitude", "e.longitude")
    percent = lambda x: f"concat(CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR),'%')"
    metres = "concat('座標距離 ',CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR),'m')"
    same, loc_ratio = "t.loc = e.loc", "(greatest(length(t.loc),length(e.loc)) - levenshtein(replace(t.loc,'区','#'),replace(e.loc,'区','#'))) / greatest(length(t.loc),length(e.loc))"
    return f"""
t AS ({side} FROM ({targets})), e AS ({side} FROM ({existing})),
x AS (SELECT t.id AS target_id, min(e.id) AS existing_id FROM t JOIN e ON t.na = e.na AND t.na <> '' AND t.id <> e.id GROUP BY t.id),
near AS (SELECT t.id AS a, e.id AS b FROM t JOIN e ON t.loc = e.loc UNION
 SELECT t.id, e.id FROM t JOIN e ON abs(t.latitude - e.latitude) < 0.0003 AND abs(t.longitude - e.longitude) < 0.0004),
p AS (SELECT t.id AS target_id, e.id AS existing_id, {same} AS local, {m} AS m, {sql_name_score('t.nm', 'e.nm')} AS name_score,
  CASE WHEN t.b1 <> e.b1 THEN 0 WHEN t.b2 <> e.b2 THEN 1 WHEN t.b3 <> e.b3 THEN 2 ELSE 3 END AS d, {loc_ratio} AS lr
  FROM near JOIN t ON t.id = a JOIN e ON e.id = b WHERE a <> b AND a NOT IN (SELECT target_id FROM x)),
c AS (SELECT *, floor((CASE WHEN NOT local THEN lr * 0.5 WHEN d = 3 THEN 0.97 ELSE 0.45 + 0.25 * d / 3 END) * 10000 + 0.5) / 10000 AS address_score FROM p
  WHERE (local AND (d = 3 OR name_score >= 0.85)) OR m <= 10 OR (m <= 30 AND name_score >= 0.5)),
k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY address_score DESC, name_score DESC, existing_id) AS rank FROM c),
found AS (
SELECT target_id, existing_id, CAST(1 AS INT) AS rank, 'CONFIRMED_DISTRIBUTED' AS status, CAST(1 AS DOUBLE) AS address_score, name_score, m,
 concat('住所完全一致（normalized_address） / 建物名は不一致だが住所一致を優先（建物名類似度 ',{percent('name_score')},'）') AS reasons
FROM (SELECT x.target_id, x.existing_id, {m} AS m, {sql_name_score('t.nm', 'e.nm')} AS name_score FROM x JOIN t ON t.id = x.target_id JOIN e ON e.id = x.existing_id)
UNION ALL
SELECT target_id, existing_id, CAST(rank AS INT), 'POSSIBLE_DUPLICATE', address_score, name_score, floor(m * 10000 + 0.5) / 10000,
 concat_ws(' / ', CASE WHEN local AND d = 3 THEN '町名・街区符号が一致（住所表記のみ相違）' END,
  CASE WHEN local AND d < 3 AND name_score >= 0.85 THEN '同一町名・番地相違だが建物名が高類似' END,
  CASE WHEN m <= 10 THEN concat({metres},'（ほぼ同一地点）') WHEN m <= 30 AND name_score >= 0.5 THEN concat({metres},' かつ建物名が類似') END,
  concat('住所類似度 ',{percent('address_score')}), concat('建物名類似度 ',{percent('name_score')})) FROM k WHERE rank <= 5)"""


_UNSERVED, _SERVED_ROWS = "SELECT * FROM master WHERE distribution_count = 0", "SELECT * FROM master WHERE distribution_count > 0"


@query("j6_duplicate_candidates", f"""WITH {_sql_candidates(_UNSERVED, _SERVED_ROWS)}
SELECT target_id, existing_id, rank, status, address_score, round(name_score, 6) AS name_score, floor(m * 10000 + 0.5) / 10000 AS distance_meters, reasons FROM found""")
def j6(t: Tables):
    """The five best candidates of every unserved building among the served ones."""
    return M.match_candidates(*_sides(t)).select(
        "target_id", "existing_id", "rank", "status", "address_score", F.round("name_score", 6).alias("name_score"),
        round4(F.col("distance_meters")).alias("distance_meters"), F.array_join("reasons", " / ").alias("reasons"))


@query("j6_confirmed_by_address", """
SELECT m.id AS target_id, min(e.id) AS existing_id FROM master m JOIN master e ON e.normalized_address = m.normalized_address
WHERE m.distribution_count = 0 AND e.distribution_count > 0 GROUP BY m.id""")
def j6_confirmed(t: Tables):
    found = M.exact_matches(*[M._side(df, label) for df, label in zip(_sides(t), "te")])
    return found.select(F.col("t.id").alias("target_id"), F.col("e.id").alias("existing_id"))


@query("j8_nearest_point", f"""
SELECT b.building_id AS row_no, p.point_id, p.m AS distance_m FROM buildings b LEFT JOIN
 (SELECT row_no, point_id, CAST(floor(m + 0.5) AS BIGINT) AS m FROM (SELECT b.building_id AS row_no, p.point_id, {sql_metres('b.latitude', 'b.longitude', 'p.latitude', 'p.longitude')} AS m,
   row_number() OVER (PARTITION BY b.building_id ORDER BY round({sql_metres('b.latitude', 'b.longitude', 'p.latitude', 'p.longitude')}, 6), p.point_id) AS rn FROM buildings b
   JOIN points p ON abs(b.latitude - p.latitude) < 0.003 AND abs(b.longitude - p.longitude) < 0.003) WHERE rn = 1 AND m <= 200) p ON p.row_no = b.building_id""")
def j8(t: Tables):
    rows = t.buildings.select(F.col("building_id").alias("row_no"), "latitude", "longitude")
    return J.nearest_point(rows, t.points).select("row_no", "point_id", "distance_m")


@query("a16_completion_outcome", f"""
SELECT count(*) AS requested, count(p.hit) AS completed, count(*) - count(p.hit) AS failed, round(count(p.hit) / count(*) * 100, 1) AS rate_percent
FROM buildings b LEFT JOIN (SELECT DISTINCT b.building_id AS hit FROM buildings b JOIN points p ON abs(b.latitude - p.latitude) < 0.003
 AND abs(b.longitude - p.longitude) < 0.003 AND {sql_metres('b.latitude', 'b.longitude', 'p.latitude', 'p.longitude')} <= 200) p ON p.hit = b.building_id""")
def a16(t: Tables):
    rows = t.buildings.select(F.col("building_id").alias("row_no"), "latitude", "longitude")
    return A.completion_outcome(J.complete_addresses(rows, t.points, "東京都", "荒川区"))


@query("j9_gazetteer_lookup", """
SELECT building_id, CASE WHEN building_id % 3 = 0 THEN NULL ELSE glat END AS latitude, CASE WHEN building_id % 3 = 0 THEN NULL ELSE glon END AS longitude
FROM (SELECT b.building_id, g.la AS glat, g.lo AS glon FROM buildings b JOIN (SELECT address, min(latitude) AS la, arg_min(longitude, latitude * 1000 + longitude / 1000) AS lo
 FROM buildings WHERE building_id % 3 <> 0 GROUP BY address) g ON g.address = b.address WHERE b.building_id % 3 <> 0
 UNION ALL SELECT building_id, NULL, NULL FROM buildings WHERE building_id % 3 = 0)""")
def j9(t: Tables):
    rows = t.buildings.select("building_id", F.concat(F.lit("　"), F.when(F.col("building_id") % 3 != 0, F.col("address")), F.lit(" ")).alias("address"))
    return J.lookup_points(rows, t.buildings.filter("building_id % 3 <> 0")).select("building_id", "latitude", "longitude")


_BLOCK = "concat_ws('/',city,town,CAST(chome AS VARCHAR),CAST(block AS VARCHAR))"


@query("j10_pairs_by_block", f"""
WITH k AS (SELECT building_id, {_BLOCK} AS block_key FROM buildings)
SELECT a.building_id AS id, b.building_id AS other, a.block_key FROM k a JOIN k b ON a.block_key = b.block_key WHERE a.building_id % 7 < 3 AND b.building_id % 7 >= 3""")
def j10(t: Tables):
    keyed = t.buildings.select("building_id", block_key_text(F.col("address")).alias("block_key"))
    a = keyed.filter("building_id % 7 < 3").select(F.col("building_id").alias("id"), "block_key")
    b = keyed.filter("building_id % 7 >= 3").select(F.col("building_id").alias("other"), "block_key")
    return J.pairs_by_block(a, b).select("id", "other", "block_key")


@query("j16_unseen_blocks", f"""
WITH k AS (SELECT building_id, {_BLOCK} AS block_key FROM buildings)
SELECT DISTINCT block_key FROM k WHERE block_key NOT IN (SELECT block_key FROM k WHERE building_id % 4 = 0)""")
def j16(t: Tables):
    keyed = t.buildings.select("building_id", block_key_text(F.col("address")).alias("block_key"))
    done = keyed.filter("building_id % 4 = 0").select("block_key", F.lit("a").alias("source"))
    return J.unseen_blocks(keyed, done.unionByName(keyed.select("block_key", F.lit("b").alias("source"))), "a")


# -- name verdicts: a candidate for every building, up to 22 m from its owner ------
_CANDS = """
SELECT concat(city,'/',town) AS block_key, concat('棟',CAST(building_id - building_id % 2 AS STRING)) AS name, address, 'archive' AS source,
 latitude + CAST(0.0001 AS DOUBLE) * CAST(building_id % 3 AS DOUBLE) AS latitude, longitude FROM buildings
"""
_VERDICT_SQL = f"""
c AS (SELECT DISTINCT block_key, name, address, source, latitude, longitude FROM ({_CANDS})),
t AS (SELECT building_id AS id, concat(city,'/',town) AS block_key, latitude, longitude FROM buildings),
p AS (SELECT t.id, t.block_key, c.name, c.address, c.source, {sql_metres('t.latitude', 't.longitude', 'c.latitude', 'c.longitude', 6371000.0)} AS m FROM t JOIN c USING (block_key)),
r AS (SELECT *, row_number() OVER w AS rn, lead(m) OVER w AS m2 FROM p WINDOW w AS (PARTITION BY id ORDER BY round(m, 6), source, address, name)),
b AS (SELECT *, count(*) FILTER (m <= 40) OVER (PARTITION BY block_key, source, address, name) AS claims FROM r WHERE rn = 1)"""


def _targets(t: Tables):
    return t.buildings.select(F.col("building_id").alias("id"), F.concat_ws("/", "city", "town").alias("block_key"), "latitude", "longitude")


def _name_candidates(t: Tables):
    return t.spark.sql(_CANDS.replace("FROM buildings", "FROM {b}"), b=t.buildings)


@query("w1_name_verdicts", f"""WITH {_VERDICT_SQL}
SELECT t.id, CASE WHEN b.m IS NULL THEN 'NOT_FOUND' WHEN b.m > 40 OR coalesce(b.m2 < b.m * 2.5, false) OR (b.m <= 40 AND b.claims > 1) THEN 'AMBIGUOUS' ELSE 'HIGH' END AS verdict,
 round(b.m, 3) AS distance_meters FROM t LEFT JOIN b USING (id)""")
def w1(t: Tables):
    done = N.match_names(_targets(t), _name_candidates(t))
    return done.select("id", "verdict", F.round("distance_meters", 3).alias("distance_meters"))


@query("w2_name_alternatives", f"""WITH {_VERDICT_SQL} SELECT id, rn AS rank, name, round(m, 3) AS distance FROM r WHERE rn <= 5""")
def w2(t: Tables):
    done = N.nearest_in_block(_targets(t), _name_candidates(t))
    return done.select("id", F.col("rank").cast("long").alias("rank"), F.col("candidate.name").alias("name"), F.round("distance", 3).alias("distance"))


@query("w3_top_candidates", f"""WITH {_sql_candidates(_UNSERVED, _SERVED_ROWS)}
SELECT target_id AS new_id, existing_id AS other_id, rank FROM found WHERE rank <= 3""")
def w3(t: Tables):
    """The three best candidates of every unserved building."""
    best = M.match_candidates(*_sides(t), top=3)
    return best.select(F.col("target_id").alias("new_id"), F.col("existing_id").alias("other_id"), "rank")


# -- name lists ------------------------------------------------------------------
_LIST = """
SELECT building_id AS line, CASE WHEN building_id % 20 = 0 THEN '' WHEN building_id % 11 = 0 THEN '22' WHEN building_id % 13 = 0 THEN concat('x',CAST(building_id AS STRING))
  ELSE CAST(building_id AS STRING) END AS building_id, address, CASE WHEN building_id % 7 = 0 THEN '' ELSE building_name END AS building_name,
 CASE building_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'AMBIGUOUS' ELSE 'maybe' END AS status, 'homes' AS source, '' AS note FROM buildings
"""


def name_list(t: Tables):
    return t.spark.sql(_LIST.replace("FROM buildings", "FROM {b}"), b=t.buildings)


_CHECKED_SQL = f"""
l AS (SELECT *, upper(status) AS st, CASE WHEN building_id <> '' THEN min(line) OVER (PARTITION BY building_id) END AS first_line FROM ({_LIST})),
k AS (SELECT *, CASE WHEN building_id = '' THEN 'no_id' WHEN first_line < line THEN 'repeat' WHEN st NOT IN ('CONFIRMED','HIGH','AMBIGUOUS','NOT_FOUND') THEN 'status'
 WHEN st IN ('CONFIRMED','HIGH') AND building_name = '' THEN 'no_name' END AS err FROM l)"""


@query("q1_row_validation", f"""WITH {_CHECKED_SQL} SELECT line, CASE err WHEN 'no_id' THEN 'building_id が空です。'
 WHEN 'repeat' THEN concat('building_id が ',CAST(first_line AS VARCHAR),' 行目と重複しています（',building_id,'）。')
 WHEN 'status' THEN concat('status が不正です（',st,'）。許可値: CONFIRMED / HIGH / AMBIGUOUS / NOT_FOUND')
 WHEN 'no_name' THEN concat('status が ',st,' なのに building_name が空です。') END AS error FROM k""")
def q1(t: Tables):
    return check_completion_rows(name_list(t)).select("line", "error")


_CURRENT_NAME = "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '（建物名不明）' WHEN CAST(id AS BIGINT) % 3 = 1 THEN building_name ELSE concat('旧',building_name) END"


def renamed_master(t: Tables):
    k = F.col("id").cast("long") % 3
    name = F.when(k == 0, vocab.UNKNOWN_NAME).when(k == 1, F.col("building_name")).otherwise(F.concat(F.lit("旧"), "building_name"))
    return t.master.withColumn("building_name", name)


@query("j12_name_list_plan", f"""WITH {_CHECKED_SQL}, c AS (SELECT id, {_CURRENT_NAME} AS current_name FROM master)
SELECT k.line, CASE WHEN c.id IS NULL THEN 'error' WHEN st NOT IN ('CONFIRMED','HIGH') OR current_name <> '（建物名不明）' THEN 'skip' ELSE 'update' END AS decision,
 CASE WHEN c.id IS NULL THEN '該当する建物がない' WHEN st NOT IN ('CONFIRMED','HIGH') THEN '確度が不足' WHEN current_name = '（建物名不明）' THEN NULL
  WHEN current_name = k.building_name THEN '同じ名前で更新済み' ELSE '既存名あり' END AS reason
FROM k LEFT JOIN c ON c.id = k.building_id WHERE err IS NULL""")
def j12(t: Tables):
    rows = check_completion_rows(name_list(t)).filter("error is null")
    return J.plan_name_updates(rows, renamed_master(t)).select("line", "decision", "reason")


@query("a9_name_plan_counts", f"""WITH {_CHECKED_SQL}, c AS (SELECT id, {_CURRENT_NAME} AS current_name FROM master),
p AS (SELECT CASE WHEN c.id IS NULL THEN 'error' WHEN st NOT IN ('CONFIRMED','HIGH') OR current_name <> '（建物名不明）' THEN 'skip' ELSE 'update' END AS decision,
 CASE WHEN c.id IS NULL THEN '該当する建物がない' WHEN st NOT IN ('CONFIRMED','HIGH') THEN '確度が不足' WHEN current_name = '（建物名不明）' THEN NULL
  WHEN current_name = k.building_name THEN '同じ名前で更新済み' ELSE '既存名あり' END AS reason FROM k LEFT JOIN c ON c.id = k.building_id WHERE err IS NULL)
SELECT decision, reason, count(*) AS count FROM p GROUP BY 1, 2""")
def a9_names(t: Tables):
    rows = check_completion_rows(name_list(t)).filter("error is null")
    return A.name_plan_counts(J.plan_name_updates(rows, renamed_master(t)))
