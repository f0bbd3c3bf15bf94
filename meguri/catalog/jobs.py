"""Queries: batch jobs on snapshots, and the streamed rollup."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meguri.catalog.base import Tables, query, sql_metres, sql_name_score
from meguri.catalog.matching import (
    _CHECKED_SQL, _CURRENT_NAME, PAST_MATCH_SQL, _sql_candidates, _sql_new_match, name_list, new_rows, past_rows, renamed_master,
)
from meguri.catalog.scalars import _ADDRESS_SQL, _ELEMENTS, _REASON_SQL, elements
from meguri.functions import vocab
from meguri.operators import aggregates as A
from meguri.operators import filters as L
from meguri.operators import joins as J
from meguri.operators import quality as Q
from meguri.plans import housekeeping as H
from meguri.plans import ingest as I
from meguri.plans import mapdata as G
from meguri.plans import names as N
from meguri.plans import research as R
from meguri.plans import review as V
from meguri.session import new_path, settled
from meguri.sources import store
from meguri.streaming import history as X

_SERVED = "(SELECT min(id) FROM master s WHERE s.distribution_count > 0 AND s.normalized_address = n.na)"
_NEW_DISTANCE = sql_metres("n.latitude", "n.longitude", "e.latitude", "e.longitude")
# What becomes of each new row; the ones that are created have a waiting pair if a served building is near.
_DECIDED = f"""{_sql_new_match()},
dn AS (SELECT n.*, n.source_ref LIKE 'mock%' AS dev, {_SERVED} AS served_id, coalesce(by_ref, by_both, by_near, by_away) AS hit_id,
  CASE WHEN n.row_no % 5 = 4 THEN CAST(n.row_no AS VARCHAR) ELSE concat('kustomer',regexp_extract(n.building_name,'[0-9]+')) END AS nm FROM r JOIN n USING (row_no)),
pd AS (SELECT DISTINCT n.row_no FROM dn n JOIN master e ON e.distribution_count > 0 AND abs(n.latitude - e.latitude) < 0.0003 AND abs(n.longitude - e.longitude) < 0.0004
  WHERE served_id IS NULL AND hit_id IS NULL AND ({_NEW_DISTANCE} <= 10 OR ({_NEW_DISTANCE} <= 30 AND
   {sql_name_score("n.nm", "concat('kustomer',regexp_extract(e.building_name,'[0-9]+'))")} >= 0.5))),
de AS (SELECT dn.*, CASE WHEN coalesce(dev, false) THEN 'skipped' WHEN served_id IS NOT NULL THEN 'already_distributed' WHEN hit_id IS NOT NULL THEN 'merged'
   WHEN pd.row_no IS NOT NULL THEN 'possible_duplicate' ELSE 'inserted' END AS outcome, sha256(concat('batch|',na,'|',nn,'|',CAST(dn.row_no AS VARCHAR))) AS new_id
  FROM dn LEFT JOIN pd ON pd.row_no = dn.row_no)"""


@query("t1_preview", f"""WITH {_DECIDED}
SELECT row_no, outcome, CASE outcome WHEN 'skipped' THEN NULL WHEN 'already_distributed' THEN served_id WHEN 'merged' THEN hit_id ELSE new_id END AS building_id FROM de""")
def t1(t: Tables):
    """Outcome of every new row and the building it goes to."""
    return I.preview(new_rows(t), t.snapshot).select("row_no", "outcome", "building_id")


@query("t2_past_ingest", f"""WITH {PAST_MATCH_SQL}
SELECT row_no, CASE WHEN coalesce(both_id, addr_id, name_id) IS NULL THEN 'skipped' ELSE 'merged' END AS outcome, coalesce(both_id, addr_id, name_id) AS building_id FROM m""")
def t2(t: Tables):
    done = I.ingest(past_rows(t), t.snapshot, "import", create_unmatched=False)
    return done.results.select("row_no", "outcome", "building_id")


@query("t2_history_after", f"""WITH {PAST_MATCH_SQL}
SELECT b.id, b.distribution_count + coalesce(p.n, 0) AS distribution_count, greatest(b.last_distributed_date, p.last) AS last_distributed_date,
 CASE WHEN p.n > 0 THEN 'CONFIRMED_DISTRIBUTED' ELSE b.status END AS status
FROM master b LEFT JOIN (SELECT coalesce(both_id, addr_id, name_id) AS id, count(*) AS n, max(distributed_date) AS last FROM m GROUP BY 1) p ON p.id = b.id""")
def t2_after(t: Tables):
    done = I.ingest(past_rows(t), t.snapshot, "import", create_unmatched=False)
    return done.after.buildings.select("id", "distribution_count", "last_distributed_date", "status")


@query("t3_new_ingest", f"""WITH {_DECIDED} SELECT outcome, count(*) AS count FROM de GROUP BY 1""")
def t3(t: Tables):
    """The same decisions applied: rows per outcome, counted from the result."""
    done = I.ingest(new_rows(t), t.snapshot, "data_source")
    return done.results.groupBy("outcome").agg(F.count("*").alias("count"))


@query("t3_master_after", f"""WITH {_DECIDED}
SELECT id, building_name, normalized_address, status, source, source_ref, total_units FROM master
UNION ALL SELECT new_id, building_name, na, CASE outcome WHEN 'inserted' THEN 'NOT_DISTRIBUTED' ELSE 'POSSIBLE_DUPLICATE' END, 'data_source', source_ref, total_units
FROM de WHERE outcome IN ('inserted','possible_duplicate')""")
def t3_after(t: Tables):
    done = I.ingest(new_rows(t), t.snapshot, "data_source")
    return done.after.buildings.select("id", "building_name", "normalized_address", "status", "source", "source_ref", "total_units")


@query("w6_rows_within_batch", f"""
WITH n AS (SELECT building_id AS row_no, concat('新町',CAST(building_id % 300 AS VARCHAR),'-1') AS a, building_id % 4 AS k FROM buildings)
SELECT row_no, CASE WHEN row_no = min(row_no) OVER (PARTITION BY a, k) THEN 'inserted' ELSE 'merged' END AS outcome FROM n""")
def w6(t: Tables):
    """New rows at new addresses: the first of each name at an address is inserted."""
    k = (F.col("building_id") % 4).cast("string")
    name = F.concat(F.translate(k, "0123", "松竹梅桜"), F.lit("ハイツ"))
    at = F.concat(F.lit("新町"), (F.col("building_id") % 300).cast("string"), F.lit("-1"))
    rows = t.buildings.select(F.col("building_id").alias("row_no"), name.alias("building_name"), at.alias("address"))
    before = t.snapshot
    empty = I.Snapshot(before.buildings.limit(0), before.history.limit(0), before.candidates.limit(0))
    return I.preview(rows, empty).select("row_no", "outcome")


@query("a8_outcome_counts", f"""WITH {PAST_MATCH_SQL}, o AS (SELECT CASE WHEN coalesce(both_id, addr_id, name_id) IS NULL THEN 'skipped' ELSE 'merged' END AS outcome FROM m),
 s(outcome) AS (VALUES ('inserted'),('merged'),('already_distributed'),('possible_duplicate'),('skipped'),('excluded_use'))
SELECT s.outcome, count(o.outcome) AS count FROM s LEFT JOIN o USING (outcome) GROUP BY s.outcome""")
def a8(t: Tables):
    return A.outcome_counts(I.preview(past_rows(t), t.snapshot, create_unmatched=False))


@query("a15_import_batch", f"""WITH {PAST_MATCH_SQL}, o AS (SELECT coalesce(both_id, addr_id, name_id) AS id FROM m)
SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS inserted_rows, count(id) AS merged_rows, CAST(0 AS BIGINT) AS duplicate_rows, count(*) - count(id) AS skipped_rows, 'past.csv' AS file_name FROM o""")
def a15(t: Tables):
    results = I.preview(past_rows(t), t.snapshot, create_unmatched=False)
    return A.import_batch(results, "past.csv", mapping={"address": "住所"}).select(
        "total_rows", "inserted_rows", "merged_rows", "duplicate_rows", "skipped_rows", "file_name")


@query("o4_preview_samples", f"""WITH {PAST_MATCH_SQL}, o AS (SELECT row_no, CASE WHEN coalesce(both_id, addr_id, name_id) IS NULL THEN 'skipped' ELSE 'merged' END AS outcome FROM m)
SELECT row_no, outcome FROM o ORDER BY CASE outcome WHEN 'skipped' THEN 0 ELSE 1 END, row_no LIMIT 30""")
def o4(t: Tables):
    return L.preview_samples(I.preview(past_rows(t), t.snapshot, create_unmatched=False)).select("row_no", "outcome")


@query("t4_fill_missing", """
SELECT b.building_id AS id, coalesce(b.total_units, CASE WHEN b.building_id % 2 = 0 THEN 12 END) AS total_units,
 CASE WHEN b.property_type = 'unknown' AND b.building_id % 2 = 0 THEN 'rental' ELSE b.property_type END AS property_type FROM buildings b""")
def t4(t: Tables):
    """Every second building gets two rows merged into it; the first knows the type, the second the units."""
    two = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = t.buildings.filter("building_id % 2 = 0").select(F.col("building_id").alias("building_id"), two.alias("row_no")).select(
        "building_id", "row_no", F.when(F.col("row_no") == 2, 12).alias("total_units"),
        F.when(F.col("row_no") == 1, "rental").otherwise("unknown").alias("property_type"),
        F.lit(35.0).alias("latitude"), F.lit(139.0).alias("longitude"))
    known = t.buildings.select(F.col("building_id").alias("id"), "total_units", "property_type", "latitude", "longitude")
    return I.fill_missing(known, rows).select("id", "total_units", "property_type")


def _sql_reconciled(targets: str, existing: str) -> str:
    """Marks of T5: confirmed targets, and targets with a pair that waits."""
    return f"""{_sql_candidates(targets, existing)},
confirmed AS (SELECT target_id AS id FROM found WHERE status = 'CONFIRMED_DISTRIBUTED'),
waiting AS (SELECT DISTINCT target_id AS id FROM found f WHERE status = 'POSSIBLE_DUPLICATE' AND (target_id IN (SELECT new_building_id FROM pairs WHERE status = 'pending')
  OR NOT EXISTS (SELECT 1 FROM pairs p WHERE p.new_building_id = f.target_id AND p.possible_existing_building_id = f.existing_id)))"""


_RECONCILED = _sql_reconciled(
    "SELECT * FROM master WHERE distribution_count = 0 AND status <> 'CONFIRMED_DISTRIBUTED'", "SELECT * FROM master WHERE distribution_count > 0")


@query("t5_reconcile", f"""WITH {_RECONCILED}
SELECT m.id, CASE WHEN c.id IS NOT NULL THEN 'CONFIRMED_DISTRIBUTED' WHEN w.id IS NOT NULL THEN 'POSSIBLE_DUPLICATE' ELSE m.status END AS status
FROM master m LEFT JOIN confirmed c ON c.id = m.id LEFT JOIN waiting w ON w.id = m.id""")
def t5(t: Tables):
    cities = t.snapshot.buildings.select("city").distinct()
    return I.reconcile(t.snapshot, cities).after.buildings.select("id", "status")


@query("t5_reconcile_counts", f"""WITH {_RECONCILED}
SELECT (SELECT count(*) FROM confirmed) AS confirmed, (SELECT count(*) FROM waiting JOIN master USING (id) WHERE status <> 'POSSIBLE_DUPLICATE') AS possible_duplicate""")
def t5_counts(t: Tables):
    return I.reconcile(t.snapshot, t.snapshot.buildings.select("city").distinct()).counts


@query("t6_mark_distributed", """
SELECT id, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'CONFIRMED_DISTRIBUTED' ELSE status END AS status,
 CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN distribution_count + 1 ELSE distribution_count END AS distribution_count,
 CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN DATE '2026-03-01' ELSE last_distributed_date END AS last_distributed_date FROM master""")
def t6(t: Tables):
    chosen = t.snapshot.buildings.filter(F.col("id").cast("long") % 6 == 0).select("id")
    after = I.mark_distributed(t.snapshot, chosen, date(2026, 3, 1), "配布班", "")
    return after.buildings.select("id", "status", "distribution_count", "last_distributed_date")


@query("t6_pairs_after", """
SELECT id, CASE WHEN status = 'pending' AND CAST(new_building_id AS BIGINT) % 6 = 0 THEN 'same' ELSE status END AS status FROM pairs""")
def t6_pairs(t: Tables):
    chosen = t.snapshot.buildings.filter(F.col("id").cast("long") % 6 == 0).select("id")
    return I.mark_distributed(t.snapshot, chosen, date(2026, 3, 1)).candidates.select("id", "status")


@query("t7_apply_decisions", """
WITH d AS (SELECT p.new_building_id AS id, CASE WHEN CAST(p.id AS BIGINT) % 2 = 0 THEN 'same' ELSE 'different' END AS decision,
  coalesce(o.last_distributed_date, DATE '2026-03-01') AS on_date FROM pairs p LEFT JOIN master o ON o.id = p.possible_existing_building_id WHERE p.status = 'pending')
SELECT m.id, m.distribution_count + (CASE WHEN d.decision = 'same' THEN 1 ELSE 0 END) AS distribution_count,
 CASE WHEN d.decision = 'same' THEN greatest(m.last_distributed_date, d.on_date) ELSE m.last_distributed_date END AS last_distributed_date,
 CASE WHEN d.decision = 'same' THEN 'CONFIRMED_DISTRIBUTED' WHEN d.decision = 'different' AND m.distribution_count = 0 THEN 'NOT_DISTRIBUTED' ELSE m.status END AS status
FROM master m LEFT JOIN d ON d.id = m.id""")
def t7(t: Tables):
    """Every waiting pair is judged, by the parity of its id."""
    same = F.col("id").cast("long") % 2 == 0
    decisions = t.candidates.filter("status = 'pending'").select("id", F.when(same, "same").otherwise("different").alias("decision"))
    after = V.apply_decisions(t.snapshot, decisions, date(2026, 3, 1))
    return after.buildings.select("id", "distribution_count", "last_distributed_date", "status")


@query("t8_edit_names", f"""
WITH e AS (SELECT id, CASE CAST(id AS BIGINT) % 30 WHEN 0 THEN ' ' WHEN 10 THEN repeat('長',201) ELSE concat('新名 ',id) END AS nm FROM master WHERE CAST(id AS BIGINT) % 10 = 0)
SELECT m.id, CASE WHEN CAST(m.id AS BIGINT) % 30 = 20 THEN concat('新名 ',m.id) ELSE m.building_name END AS building_name,
 CASE WHEN CAST(m.id AS BIGINT) % 30 = 20 THEN concat('新名',m.id) ELSE m.normalized_building_name END AS normalized_building_name,
 CASE WHEN CAST(m.id AS BIGINT) % 30 = 20 THEN 'manual' END AS name_source FROM master m LEFT JOIN e ON e.id = m.id""")
def t8(t: Tables):
    k = F.col("id").cast("long")
    name = F.when(k % 30 == 0, " ").when(k % 30 == 10, F.repeat(F.lit("長"), 201)).otherwise(F.concat(F.lit("新名 "), "id"))
    edits = t.snapshot.buildings.filter(k % 10 == 0).select("id", name.alias("building_name"))
    return N.edit_names(t.snapshot.buildings, edits).buildings.select("id", "building_name", "normalized_building_name", "name_source")


@query("t9_apply_name_list", f"""WITH {_CHECKED_SQL}, c AS (SELECT id, {_CURRENT_NAME} AS current_name FROM master),
u AS (SELECT c.id, k.building_name FROM k JOIN c ON c.id = k.building_id WHERE err IS NULL AND st IN ('CONFIRMED','HIGH') AND current_name = '（建物名不明）')
SELECT c.id, coalesce(u.building_name, c.current_name) AS building_name, CASE WHEN u.id IS NOT NULL THEN 'csv' END AS name_source FROM c LEFT JOIN u USING (id)""")
def t9(t: Tables):
    """The valid rows of the list, applied; a list with an error would apply nothing."""
    checked = Q.check_completion_rows(name_list(t)).filter("error is null")
    known = checked.join(t.snapshot.buildings.select(F.col("id").alias("building_id")), "building_id", "left_semi")
    done = N.apply_name_list(renamed_master(t), known)
    return done.buildings.select("id", "building_name", "name_source")


@query("t9_list_with_errors", f"SELECT id, {_CURRENT_NAME} AS building_name, CAST(NULL AS VARCHAR) AS name_source FROM master")
def t9_errors(t: Tables):
    """The whole list, which has errors: nothing of it is applied."""
    done = N.apply_name_list(renamed_master(t), Q.check_completion_rows(name_list(t)))
    return done.buildings.select("id", "building_name", "name_source")


@query("j21_coordinate_enrichment", """
SELECT b.building_id, coalesce(CASE WHEN b.building_id % 4 <> 0 THEN b.latitude END, g.la) AS latitude,
 CASE WHEN b.building_id % 4 <> 0 THEN b.longitude ELSE g.lo END AS longitude
FROM buildings b LEFT JOIN (SELECT address, min(latitude) AS la, arg_min(longitude, latitude * 1000 + longitude / 1000) AS lo FROM buildings WHERE building_id % 8 <> 0 GROUP BY address) g
 ON g.address = b.address""")
def j21(t: Tables):
    """Buildings without coordinates get those of a gazetteer, by address; known ones stay."""
    known = F.col("building_id") % 4 != 0
    rows = t.buildings.select("building_id", "address", F.when(known, F.col("latitude")).alias("latitude"), F.when(known, F.col("longitude")).alias("longitude"))
    return J.lookup_points(rows, t.buildings.filter("building_id % 8 <> 0")).select("building_id", "latitude", "longitude")


@query("t10_complete_names", f"""
WITH b AS (SELECT *, concat_ws('/',city,town,CAST(chome AS VARCHAR),CAST(block AS VARCHAR)) AS bk FROM buildings),
g AS (SELECT address, min(latitude) AS la, arg_min(longitude, latitude * 1000 + longitude / 1000) AS lo FROM buildings GROUP BY address),
c AS (SELECT b.bk, concat('名称',CAST(b.building_id AS VARCHAR)) AS name, b.address, g.la, g.lo FROM b JOIN g ON g.address = b.address),
p AS (SELECT t.building_id, t.bk, c.name, c.address, {sql_metres('t.latitude', 't.longitude', 'c.la', 'c.lo', 6371000.0)} AS m
 FROM b t JOIN c ON c.bk = t.bk WHERE t.building_id % 2 = 0 AND t.building_id % 10 <> 4),
r AS (SELECT *, row_number() OVER w AS rn, lead(m) OVER w AS m2 FROM p WINDOW w AS (PARTITION BY building_id ORDER BY round(m, 6), address, name)),
v AS (SELECT *, count(*) FILTER (m <= 40) OVER (PARTITION BY bk, address, name) AS claims FROM r WHERE rn = 1)
SELECT CAST(b.building_id AS VARCHAR) AS id, CASE WHEN v.m <= 40 AND v.claims = 1 AND NOT coalesce(v.m2 < v.m * 2.5, false) THEN v.name
 WHEN b.building_id % 2 = 0 THEN '（建物名不明）' ELSE b.building_name END AS building_name FROM b LEFT JOIN v ON v.building_id = b.building_id""")
def t10(t: Tables):
    """Every second building lost its name; a landed candidate stands at each building's address."""
    k = F.col("id").cast("long")
    source = F.when(k % 10 == 4, "manual")
    stored = t.snapshot.buildings.withColumns({"building_name": F.when(k % 2 == 0, vocab.UNKNOWN_NAME).otherwise(F.col("building_name")), "name_source": source})
    landed = t.buildings.select(F.concat(F.lit("名称"), F.col("building_id").cast("string")).alias("name"), "address", F.lit("archive").alias("source"))
    spark = t.spark
    lookups = spark.createDataFrame([], "block_key string, source string, candidate_count bigint")
    found = spark.createDataFrame([], "block_key string, name string, address string, source string")
    return N.complete_names(stored, landed, lookups, found, t.buildings, "archive").buildings.select("id", "building_name")


@query("t17_backfill_manual", """
SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'auto' WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 'manual' END AS name_source FROM master""")
def t17(t: Tables):
    rows = renamed_master(t).withColumn("name_source", F.when(F.col("id").cast("long") % 4 == 0, "auto"))
    return N.backfill_manual(rows).select("id", "name_source")


# -- research lists --------------------------------------------------------------
_RESEARCH = """
SELECT CAST(building_id AS BIGINT) + 1 AS line, CASE WHEN building_id % 4 = 0 THEN CAST(building_id AS STRING) WHEN building_id % 37 = 1 THEN 'none' ELSE '' END AS building_id,
 CASE WHEN building_id % 5 = 0 THEN concat('新',building_name) ELSE building_name END AS building_name,
 CASE building_id % 6 WHEN 0 THEN address WHEN 1 THEN concat(city,town,CAST(chome AS STRING),'丁目',CAST(block AS STRING),'番',CAST(house AS STRING),'号')
  WHEN 2 THEN concat(address,'-7') WHEN 3 THEN concat(city,town,CAST(chome AS STRING),'-',CAST(block AS STRING),'-99') WHEN 4 THEN concat('架空区丘',CAST(chome AS STRING),'-',CAST(building_id AS STRING)) ELSE city END AS address,
 CASE building_id % 3 WHEN 0 THEN '8' WHEN 1 THEN '' ELSE '約30' END AS total_units, CASE WHEN building_id % 2 = 0 THEN '賃貸' ELSE '' END AS property_type,
 '' AS building_type, CASE WHEN building_id % 8 = 7 THEN 'blog' ELSE 'ChatGPT' END AS source, '' AS note FROM buildings
"""


def research_rows(t: Tables):
    rows = t.spark.sql(_RESEARCH.replace("FROM buildings", "FROM {b}"), b=t.buildings)
    return Q.check_research_rows(rows).filter("error is null").drop("error")


_MATCH_SQL = f"""
r AS (SELECT * FROM (SELECT *, min(line) OVER (PARTITION BY building_id) AS fl FROM ({_RESEARCH})) WHERE building_id = '' OR fl = line),
ca AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(address,'[丁目番地]','-','g'),'号','','g'),'-+','-','g') AS c1 FROM r),
q AS (SELECT *, regexp_replace(c1,'-$','') AS c, regexp_extract(regexp_replace(address,'丁目|番','-','g'),'^([^区]+区)(.+?)([0-9]+)-([0-9]+)',['a','t','ch','bl']) AS k FROM ca),
qq AS (SELECT *, CASE WHEN k.ch <> '' THEN concat_ws('/',k.a,k.t,k.ch,k.bl) END AS bk FROM q),
b AS (SELECT CAST(building_id AS VARCHAR) AS id, address AS c, building_name AS nm, total_units, property_type, concat_ws('/',city,town,CAST(chome AS VARCHAR),CAST(block AS VARCHAR)) AS bk FROM buildings),
m AS (SELECT qq.*, (SELECT count(*) FROM b WHERE b.c = qq.c) AS n, (SELECT min(id) FROM b WHERE b.c = qq.c) AS one,
 (SELECT count(*) FROM b WHERE b.c = qq.c AND lower(replace(b.nm,'#','')) = lower(replace(qq.building_name,'#',''))) AS nn,
 (SELECT min(id) FROM b WHERE b.c = qq.c AND lower(replace(b.nm,'#','')) = lower(replace(qq.building_name,'#',''))) AS named,
 (SELECT count(*) FROM b WHERE b.bk = qq.bk) AS in_block, (SELECT count(*) FROM b WHERE b.bk = qq.bk AND starts_with(qq.c, b.c)) AS pn,
 (SELECT min(id) FROM b WHERE b.bk = qq.bk AND starts_with(qq.c, b.c)) AS pone,
 (SELECT count(*) FROM b WHERE b.bk = qq.bk AND starts_with(qq.c, b.c) AND lower(replace(b.nm,'#','')) = lower(replace(qq.building_name,'#',''))) AS pnn,
 (SELECT min(id) FROM b WHERE b.bk = qq.bk AND starts_with(qq.c, b.c) AND lower(replace(b.nm,'#','')) = lower(replace(qq.building_name,'#',''))) AS pnamed,
 (SELECT min(id) FROM b WHERE b.id = qq.building_id) AS by_id FROM qq),
j AS (SELECT *, CASE WHEN building_id <> '' THEN CASE WHEN by_id IS NOT NULL THEN 'id' END WHEN n = 1 THEN 'address_one' WHEN n > 1 THEN 'address_many' WHEN pn = 1 THEN 'block_prefix_one'
  WHEN pn > 1 THEN 'block_prefix_many' WHEN bk IS NULL THEN 'address_unreadable' WHEN in_block > 0 THEN 'block_no_prefix' ELSE 'block_absent' END AS match_kind,
 CASE WHEN building_id <> '' THEN by_id WHEN n = 1 THEN one WHEN n > 1 THEN CASE WHEN nn = 1 THEN named END WHEN pn = 1 THEN pone WHEN pn > 1 THEN CASE WHEN pnn = 1 THEN pnamed END END AS matched_id FROM m)"""


@query("j13_research_match", f"WITH {_MATCH_SQL} SELECT line, matched_id, match_kind FROM j")
def j13(t: Tables):
    return R.match_rows(research_rows(t), t.snapshot.buildings).select("line", "matched_id", "match_kind")


@query("a10_match_kinds", f"""WITH {_MATCH_SQL}, s(match_kind) AS (VALUES ('id'),('address_one'),('address_many'),('block_prefix_one'),('block_prefix_many'),('block_no_prefix'),('block_absent'),('address_unreadable'))
SELECT s.match_kind, count(j.line) AS count FROM s LEFT JOIN j USING (match_kind) GROUP BY s.match_kind""")
def a10(t: Tables):
    return A.match_kind_counts(R.match_rows(research_rows(t), t.snapshot.buildings))


_VERDICT = """
v AS (SELECT j.*, b.nm AS cur_name, b.total_units AS cur_units, b.property_type AS cur_type, b.c AS cur_c, b.bk AS cur_bk FROM j LEFT JOIN b ON b.id = j.matched_id),
w AS (SELECT *, building_name <> cur_name AS name_conflict, CASE WHEN c = cur_c THEN 'none' WHEN bk IS NULL THEN 'conflict' WHEN bk <> cur_bk AND split_part(bk,'/',1) <> split_part(cur_bk,'/',1)
   AND split_part(bk,'/',2) = split_part(cur_bk,'/',2) AND split_part(bk,'/',3) = split_part(cur_bk,'/',3) AND split_part(bk,'/',4) = split_part(cur_bk,'/',4) THEN 'conflict'
  WHEN bk <> cur_bk THEN 'conflict' WHEN starts_with(c, cur_c) THEN 'detail' ELSE 'conflict' END AS addr,
 total_units = '8' AND coalesce(cur_units, -1) <> 8 AS set_units, property_type = '賃貸' AND cur_type <> 'rental' AS set_type,
 total_units = '約30' OR source = 'blog' AS review FROM v),
z AS (SELECT *, CASE WHEN matched_id IS NULL AND building_id = '' AND match_kind IN ('block_no_prefix','block_absent') THEN '新規登録'
 WHEN matched_id IS NULL AND match_kind IN ('address_many','block_prefix_many') THEN '要確認' WHEN matched_id IS NULL THEN '照合不可'
 WHEN name_conflict THEN '建物名競合' WHEN addr = 'conflict' THEN '住所競合' WHEN review THEN '要確認'
 WHEN NOT (addr = 'detail' OR set_units OR set_type) THEN '変更なし' ELSE '更新可能' END AS verdict FROM w)"""


@query("t11_research_plan", f"WITH {_MATCH_SQL}, {_VERDICT} SELECT line, verdict FROM z")
def t11(t: Tables):
    return R.plan_research(research_rows(t), t.snapshot.buildings, allow_create=True).select("line", "verdict")


@query("a9_research_plan_counts", f"""WITH {_MATCH_SQL}, {_VERDICT}
SELECT count(*) AS total, count(*) FILTER (verdict = '更新可能') AS updatable, count(*) FILTER (verdict = '新規登録') AS creatable,
 count(*) FILTER (verdict IN ('建物名競合','住所競合','要確認')) AS needs_review, count(*) FILTER (verdict = '照合不可') AS unmatched,
 count(*) FILTER (verdict = '変更なし') AS no_change, CAST(0 AS BIGINT) AS error FROM z""")
def a9(t: Tables):
    return A.research_plan_counts(R.plan_research(research_rows(t), t.snapshot.buildings, allow_create=True))


@query("t12_address_decision", """
SELECT building_id, CASE building_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'detail' ELSE 'conflict' END AS kind FROM buildings""")
def t12(t: Tables):
    k = F.col("building_id") % 5
    proposed = (
        F.when(k == 0, F.col("address")).when(k == 1, F.concat("address", F.lit("-3")))
        .when(k == 2, F.concat(F.col("city"), F.lit("別町1-1"))).when(k == 3, F.concat(F.col("city"), F.col("town"), F.lit("9-"), F.col("block").cast("string")))
        .otherwise(F.col("city")))
    done = R.with_address_decision(t.buildings.withColumn("proposed", proposed), "address", "proposed", "d")
    return done.select("building_id", "d.kind")


def _applied(t: Tables):
    plan = settled(R.plan_research(research_rows(t), t.snapshot.buildings, allow_create=True), "plan")
    return R.apply_research(t.snapshot.buildings, plan, plan.select("line"), "batch-1")


@query("f12_line_selection", f"WITH {_MATCH_SQL}, {_VERDICT} SELECT line FROM z WHERE verdict IN ('更新可能','新規登録') AND line % 2 = 0")
def f12(t: Tables):
    plan = R.plan_research(research_rows(t), t.snapshot.buildings, allow_create=True)
    chosen = t.buildings.select((F.col("building_id") + 1).alias("line")).filter("line % 2 = 0")
    return L.select_lines(plan, chosen, ["更新可能", "新規登録"]).select("line")


@query("t13_apply_research", f"""WITH {_MATCH_SQL}, {_VERDICT},
p AS (SELECT matched_id AS id, arg_max(address, line) FILTER (addr = 'detail') AS address, max(8) FILTER (set_units) AS units, max('rental') FILTER (set_type) AS kind FROM z WHERE verdict = '更新可能' GROUP BY 1)
SELECT mm.id, coalesce(p.address, mm.address) AS address, coalesce(p.units, mm.total_units) AS total_units, coalesce(p.kind, mm.property_type) AS property_type
FROM master mm LEFT JOIN p USING (id)""")
def t13(t: Tables):
    done = _applied(t).buildings.join(t.snapshot.buildings.select("id"), "id", "left_semi")
    return done.select("id", "address", "total_units", "property_type")


@query("t13_created", f"""WITH {_MATCH_SQL}, {_VERDICT} SELECT building_name, address, regexp_extract(address,'^([^区]+区)',1) AS city, CASE WHEN total_units = '8' THEN 8 END AS total_units FROM z WHERE verdict = '新規登録'""")
def t13_created(t: Tables):
    done = _applied(t).buildings.join(t.snapshot.buildings.select("id"), "id", "left_anti")
    return done.select("building_name", "address", "city", "total_units")


@query("t14_roll_back", "SELECT id, building_name, normalized_building_name, address, normalized_address, total_units, property_type FROM master")
def t14(t: Tables):
    """Apply, then roll back: what was updated is as it was."""
    done = _applied(t)
    back = R.roll_back(done.buildings, done.audit, "batch-1").join(t.snapshot.buildings.select("id"), "id", "left_semi")
    return back.select("id", "building_name", "normalized_building_name", "address", "normalized_address", "total_units", "property_type")


# -- housekeeping ------------------------------------------------------------------
_ARCHIVE = "version string, table_name string, row_id string, row_data string"


@query("s19_archive_and_restore", "SELECT id, building_name, total_units, latitude, last_distributed_date FROM master")
def s19(t: Tables):
    away = t.snapshot.buildings.filter(F.col("id").cast("long") % 3 == 0)
    archive = H.archive_rows(away, "buildings", "v1")
    kept = t.snapshot.buildings.filter(F.col("id").cast("long") % 3 != 0)
    back = kept.unionByName(H.restore_rows(archive, "buildings", "v1", kept))
    return back.select("id", "building_name", "total_units", "latitude", "last_distributed_date")


_GONE = "(source_ref LIKE 'mock-arakawa:%' AND distribution_count = 0)"


@query("t15_archive_delete_repair", f"""
WITH gone AS (SELECT id FROM master WHERE {_GONE}), kept AS (SELECT * FROM pairs WHERE new_building_id NOT IN (SELECT id FROM gone) AND possible_existing_building_id NOT IN (SELECT id FROM gone))
SELECT m.id, CASE WHEN m.status = 'POSSIBLE_DUPLICATE' AND m.distribution_count = 0 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.new_building_id = m.id AND k.status = 'pending')
 THEN 'NOT_DISTRIBUTED' ELSE m.status END AS status FROM master m WHERE m.id NOT IN (SELECT id FROM gone)""")
def t15(t: Tables):
    after, _ = H.remove_rows(t.snapshot, t.spark.createDataFrame([], _ARCHIVE), "0004")
    return after.buildings.select("id", "status")


@query("t15_archive", f"""
WITH gone AS (SELECT id FROM master WHERE {_GONE}) SELECT 'buildings' AS table_name, count(*) AS count FROM gone
UNION ALL SELECT 'distribution_history', count(*) FROM history WHERE CAST(building_id AS VARCHAR) IN (SELECT id FROM gone) HAVING count(*) > 0
UNION ALL SELECT 'duplicate_candidates', count(*) FROM pairs WHERE new_building_id IN (SELECT id FROM gone) OR possible_existing_building_id IN (SELECT id FROM gone)""")
def t15_archive(t: Tables):
    _, archive = H.remove_rows(t.snapshot, t.spark.createDataFrame([], _ARCHIVE), "0004")
    return archive.groupBy("table_name").agg(F.count("*").alias("count"))


@query("t16_restore", "SELECT id, status, distribution_count FROM master")
def t16(t: Tables):
    after, archive = H.remove_rows(t.snapshot, t.spark.createDataFrame([], _ARCHIVE), "0004")
    archive = settled(archive, "archive")
    middle = I.Snapshot(settled(after.buildings, "b"), after.history, settled(after.candidates, "c"))
    back, _ = H.restore_version(middle, archive, "0004")
    return back.buildings.select("id", "status", "distribution_count")


@query("q3_violations", """
SELECT 'buildings' AS table_name, 'units_not_negative' AS rule, id AS row_id FROM master WHERE CAST(id AS BIGINT) % 50 = 7 AND total_units > 0
UNION ALL SELECT 'duplicate_candidates', 'not_self', id FROM pairs WHERE CAST(id AS BIGINT) % 90 = 0
UNION ALL SELECT 'distribution_history', 'building_exists', CAST(history_id AS VARCHAR) FROM history WHERE building_id % 25 = 3
UNION ALL SELECT 'duplicate_candidates', 'building_exists', id FROM pairs WHERE CAST(new_building_id AS BIGINT) % 25 = 3 
UNION ALL SELECT 'duplicate_candidates', 'building_exists', id FROM pairs WHERE CAST(id AS BIGINT) % 90 <> 0 AND CAST(possible_existing_building_id AS BIGINT) % 25 = 3""")
def q3(t: Tables):
    """Negative units, self pairs and missing buildings, put in by formula."""
    k = F.col("id").cast("long")
    b = t.snapshot.buildings.filter(k % 25 != 3).withColumn("total_units", F.when((k % 50 == 7), -F.col("total_units")).otherwise(F.col("total_units")))
    c = t.candidates.withColumn("possible_existing_building_id", F.when(k % 90 == 0, F.col("new_building_id")).otherwise(F.col("possible_existing_building_id")))
    return Q.violations(b, t.stored_history, c)


@query("q5_admissible_rows", f"""
SELECT row_no, CASE WHEN row_no % 4 = 0 AND row_no % 3 = 0 THEN 'skipped' WHEN row_no % 5 = 0 AND row_no % 4 <> 0 THEN 'skipped' END AS rejected FROM past_list""")
def q5(t: Tables):
    """Rows without an address pass when they have a name; development rows do not."""
    k = F.col("row_no")
    rows = past_rows(t).withColumns({
        "address": F.when(k % 4 == 0, "　").otherwise(F.col("address")),
        "building_name": F.when((k % 4 == 0) & (k % 3 == 0), " ").otherwise(F.col("building_name")),
        "source_ref": F.when((k % 5 == 0) & (k % 4 != 0), "mock:1"),
    })
    return Q.prepare_rows(rows).select("row_no", "rejected")


# -- map data ------------------------------------------------------------------------
@query("t19_map_records", f"""
WITH el AS ({_ELEMENTS}), r AS (SELECT *, {_REASON_SQL} AS reason, {_ADDRESS_SQL} AS address FROM el),
a AS (SELECT *, coalesce(name,'（建物名不明）') AS nm FROM r WHERE reason IS NULL),
near AS (SELECT * FROM (SELECT a.building_id, p.town, p.block, {sql_metres('a.lat', 'a.lon', 'p.latitude', 'p.longitude')} AS m,
  row_number() OVER (PARTITION BY a.building_id ORDER BY round({sql_metres('a.lat', 'a.lon', 'p.latitude', 'p.longitude')}, 6), p.point_id) AS rn
  FROM a JOIN points p ON abs(a.lat - p.latitude) < 0.003 AND abs(a.lon - p.longitude) < 0.003 WHERE a.address IS NULL) WHERE rn = 1 AND m <= 200)
SELECT concat('osm:way/',CAST(a.building_id AS VARCHAR)) AS source_ref, a.nm AS building_name, coalesce(a.address, concat('東京都荒川区',near.town,near.block)) AS address,
 CASE WHEN a.address IS NULL THEN 'isj' ELSE 'source' END AS address_source, a.lat AS latitude, CASE WHEN a.lat IS NOT NULL THEN a.lon END AS longitude
FROM a LEFT JOIN near USING (building_id) WHERE a.address IS NOT NULL OR near.town IS NOT NULL""")
def t19(t: Tables):
    return G.records_of_elements(elements(t), t.points, "東京都", "荒川区").select(
        "source_ref", "building_name", "address", "address_source", "latitude", "longitude")


_TILE_SQL = """
g AS (SELECT town AS area, min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e,
 CAST(greatest(1, least(4, ceil(sqrt(ceil(count(*) / 1500.0))))) AS INT) AS side FROM (SELECT 'all' AS town, latitude, longitude FROM points) GROUP BY 1),
tl AS (SELECT area, r * side + c AS tile, s + (n-s)/side*r - CASE WHEN r > 0 THEN 0.0001 ELSE 0 END AS south, s + (n-s)/side*(r+1) + CASE WHEN r < side-1 THEN 0.0001 ELSE 0 END AS north,
 w + (e-w)/side*c - CASE WHEN c > 0 THEN 0.0001 ELSE 0 END AS west, w + (e-w)/side*(c+1) + CASE WHEN c < side-1 THEN 0.0001 ELSE 0 END AS east
 FROM (SELECT *, unnest(range(side)) AS r FROM g) q, range(q.side) rr(c))"""


@query("t20_tiles", f"WITH {_TILE_SQL} SELECT area, CAST(tile AS INT) AS tile, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east FROM tl")
def t20(t: Tables):
    done = G.tiles(t.points.withColumn("area", F.lit("all")), "area")
    return done.select("area", "tile", *[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


@query("t20_tile_assignment", f"""WITH {_TILE_SQL}
SELECT b.building_id, CAST(tl.tile AS INT) AS tile FROM buildings b JOIN tl ON (b.latitude BETWEEN tl.south AND tl.north AND b.longitude BETWEEN tl.west AND tl.east) OR (SELECT side FROM g) = 1""")
def t20_assign(t: Tables):
    rows = t.buildings.select("building_id", "latitude", "longitude", F.lit("all").alias("area"))
    return G.assign_tiles(rows, t.points.withColumn("area", F.lit("all")), "area").select("building_id", "tile")


_IMPORTED = f"""{PAST_MATCH_SQL},
af AS (SELECT b.* REPLACE (b.distribution_count + coalesce(p.n, 0) AS distribution_count, CASE WHEN p.n > 0 THEN 'CONFIRMED_DISTRIBUTED' ELSE b.status END AS status)
 FROM master b LEFT JOIN (SELECT coalesce(both_id, addr_id, name_id) AS id, count(*) AS n FROM m GROUP BY 1) p ON p.id = b.id),
listed AS (SELECT * FROM af WHERE city IN (SELECT city FROM buildings WHERE building_id % 3 = 0)),
{_sql_reconciled("SELECT * FROM listed WHERE distribution_count = 0 AND status <> 'CONFIRMED_DISTRIBUTED'", "SELECT * FROM listed WHERE distribution_count > 0")}"""


@query("t18_import_run", f"""WITH {_IMPORTED}
SELECT m.id, CASE WHEN c.id IS NOT NULL THEN 'CONFIRMED_DISTRIBUTED' WHEN w.id IS NOT NULL THEN 'POSSIBLE_DUPLICATE' ELSE m.status END AS status, m.distribution_count
FROM af m LEFT JOIN confirmed c ON c.id = m.id LEFT JOIN waiting w ON w.id = m.id""")
def t18(t: Tables):
    """A whole distribution-list import: status of every building afterwards."""
    run = I.run_import(past_rows(t), t.snapshot, "past.csv", {"address": "住所"})
    return run.after.buildings.select("id", "status", "distribution_count")


@query("x1_streamed_rollup", """
SELECT user_id AS building_id, count(*) AS distribution_count, max(CAST(ts AS DATE)) AS last_distributed_date FROM events GROUP BY user_id""")
def x1(t: Tables):
    batch = t.table("events")
    stream = t.spark.readStream.schema(batch.schema).parquet(f"{t.folder}/events*.parquet")
    inserts = stream.select(F.col("user_id").alias("building_id"), F.to_date("ts").alias("distributed_date"))
    path, checkpoint = new_path(t.spark, "rollup"), new_path(t.spark, "stream")
    X.start_rollup(inserts, path, checkpoint).awaitTermination()
    return X.current_rollup(t.spark, path)


@query("x1_rollup_after_deletes", """
SELECT user_id AS building_id, count(*) AS distribution_count, max(CAST(ts AS DATE)) AS last_distributed_date FROM events WHERE event_id % 3 <> 0 GROUP BY user_id""")
def x1_deletes(t: Tables):
    """Three epochs: most events, then a third of all deleted (some never seen till then), then the rest."""
    folder, path, checkpoint, smaller = (new_path(t.spark, label) for label in ("changes", "rollup", "stream", "compact"))
    events = t.table("events").select("event_id", F.col("user_id").alias("building_id"), F.to_date("ts").alias("distributed_date"))
    k = F.col("event_id")
    early, late = events.filter(k % 5 != 0).withColumn("op", F.lit("insert")), events.filter(k % 5 == 0).withColumn("op", F.lit("insert"))
    gone = events.filter(k % 3 == 0).withColumn("op", F.lit("delete"))
    for step, (rows, to) in enumerate(((early, path), (gone, path), (late, smaller))):
        rows.write.mode("append").parquet(folder)
        if step == 2:
            X.compact(t.spark, path, smaller)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        X.start_rollup(stream, to, checkpoint).awaitTermination()
    return X.current_rollup(t.spark, smaller)




@query("x1_streamed_master", """
WITH h AS (SELECT user_id AS b, count(*) AS n, max(CAST(ts AS DATE)) AS d FROM events WHERE event_id % 3 <> 0 GROUP BY user_id)
SELECT CAST(building_id AS VARCHAR) AS id, coalesce(n, 0) AS distribution_count, d AS last_distributed_date,
 CASE WHEN n > 0 THEN 'CONFIRMED_DISTRIBUTED' ELSE 'NOT_DISTRIBUTED' END AS status FROM buildings LEFT JOIN h ON b = building_id""")
def x1_master(t: Tables):
    """Two epochs into the stored master: all events, then a third of them deleted; the second is run again."""
    folder, counts, master, checkpoint = (new_path(t.spark, label) for label in ("changes", "counts", "master", "stream"))
    store.write(t.unserved_master, master, 0, "id")
    events = t.table("events").select("event_id", F.col("user_id").cast("string").alias("building_id"), F.to_date("ts").alias("distributed_date"))
    for rows, op in ((events, "insert"), (events.filter("event_id % 3 = 0"), "delete")):
        rows.withColumn("op", F.lit(op)).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.withColumn("op", F.lit(op)).schema).parquet(folder)
        X.start_master(stream, counts, master, checkpoint).awaitTermination()
    return store.read(t.spark, master).select("id", "distribution_count", "last_distributed_date", "status")


@query("t4_stored_changes", """
SELECT CAST(building_id AS VARCHAR) AS id, city, CASE WHEN city LIKE '%A区' AND building_id % 3 = 0 THEN 99 ELSE total_units END AS total_units
FROM buildings WHERE city LIKE '%A区' OR city LIKE '%J区'""")
def t4_stored(t: Tables):
    """The master stored by city; a job changes every third row of some cities, then an area is read: only its parts are."""
    path = new_path(t.spark, "master")
    store.write(t.unserved_master, path, 0, "city")
    cities = t.unserved_master.select("city").distinct()
    some = store.read_where(t.spark, path, "city", cities.filter("city LIKE '%A区'"))
    store.merge(settled(some.filter("CAST(id AS LONG) % 3 = 0").withColumn("total_units", F.lit(99)), "changed"), path, 1, "city", ["id"])
    area = store.read_where(t.spark, path, "city", cities.filter("city LIKE '%A区' OR city LIKE '%J区'"))
    return area.select("id", "city", "total_units")


@query("q2_files_without_columns", """
WITH f AS (SELECT CAST(building_id AS VARCHAR) AS file, building_id % 4 AS k FROM buildings)
SELECT file, CASE k WHEN 1 THEN 'current_name' WHEN 2 THEN 'building_id' ELSE 'building_id,current_name' END AS missing FROM f WHERE k > 0""")
def q2(t: Tables):
    """A header for every building, with one column, the other or both left out."""
    k = F.col("building_id") % 4
    columns = F.when(k == 0, F.array(F.lit("\ufeffBuilding_ID "), F.lit("current_name"))).when(k == 1, F.array(F.lit("building_id"), F.lit("x"))).when(k == 2, F.array(F.lit(" CURRENT_NAME")))
    headers = t.buildings.select(F.col("building_id").cast("string").alias("file"), columns.alias("columns"))
    return Q.file_errors(headers, ["building_id", "current_name"]).select("file", F.array_join("missing", ",").alias("missing"))


@query("q4_batches_over_limit", "SELECT city, count(*) AS n FROM buildings GROUP BY city HAVING count(*) > (SELECT count(*) / 25 FROM buildings)")
def q4(t: Tables):
    return Q.batches_over(t.buildings, "city", t.buildings.count() // 25)
