from datetime import date

import pytest
from pyspark.sql import functions as F

from meguri import schemas
from meguri.functions import vocab
from meguri.functions.address import with_address
from meguri.functions.names import normalize_name
from meguri.plans import ingest as I
from meguri.plans import review

PAST = (date(2026, 1, 1), None, None)
INPUT = ("row_no long, building_name string, address string, building_use_raw string, total_units int, property_type string, "
         "latitude double, longitude double, source_ref string, distribution struct<distributed_date:date,distributed_by:string,notes:string>")


def master(spark, rows):
    """rows: id, name, address, count, latitude, longitude, source_ref"""
    df = spark.createDataFrame(rows, "id string, building_name string, address string, distribution_count long, latitude double, longitude double, source_ref string")
    keyed = with_address(df).withColumns({
        "normalized_address": F.col("addr.normalized"), "normalized_building_name": normalize_name(F.col("building_name")),
        "city": F.lit("荒川区"), "property_type": F.lit("unknown"),
        "last_distributed_date": F.when(F.col("distribution_count") > 0, F.lit(date(2025, 5, 5))),
        "status": F.when(F.col("distribution_count") > 0, vocab.CONFIRMED).otherwise(vocab.NOT_DISTRIBUTED),
    })
    return keyed.select(*[(F.col(f.name) if f.name in keyed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.BUILDINGS])


def snapshot(spark, rows):
    m = master(spark, rows)
    served = m.filter("distribution_count > 0").select(
        F.concat(F.lit("h"), "id").alias("id"), F.col("id").alias("building_id"), F.lit(date(2025, 5, 5)).alias("distributed_date"),
        F.lit(None).cast("string").alias("distributed_by"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("timestamp").alias("created_at"))
    return I.Snapshot(m, served, spark.createDataFrame([], schemas.CANDIDATES))


def past(spark, *rows):
    return spark.createDataFrame([(i, n, a, None, None, None, None, None, None, PAST) for i, n, a in rows], INPUT)


def test_past_rows_resolve_by_address_then_exact_name(spark):
    before = snapshot(spark, [
        ("m", "メゾン丸十", "東京都荒川区西日暮里2丁目26番10号", 0, None, None, None),
        ("z", "ＭＥＺＯＮ・丸十", "東京都荒川区西日暮里2丁目27番1号", 0, None, None, None),
        ("n", "グランドメゾン中野", "東京都中野区中央1丁目2番3号", 0, None, None, None),
        ("s", "コスモステージ荒川遊園 S棟", "東京都荒川区西尾久6丁目1番1号", 0, None, None, None),
    ])
    rows = past(
        spark, (1, "メゾン丸十", "荒川区西日暮里２ー２６ー１０"), (2, "メゾン丸十", "東京都荒川区東日暮里9丁目99番9号"), (3, "mezon･丸十", "東京都荒川区東日暮里9丁目99番9号"),
        (4, "まったく別の名前", "東京都荒川区西日暮里2丁目26番10号"), (5, "存在しないマンション", "東京都荒川区東日暮里9丁目99番9号"),
        (6, "メゾン丸十第二", "東京都荒川区東日暮里9丁目99番9号"), (7, "", ""), (8, "メゾン丸十", ""), (9, "GRAND MAISON NAKANO", "東京都中野区中央1丁目2番3号"),
        (10, "GRAND MAISON NAKANO", "東京都中野区中央9丁目9番9号"), (11, "グランドメゾン新宿", "東京都中野区中央9丁目9番9号"), (12, "コスモステージ荒川遊園 N棟", "東京都荒川区西尾久9丁目9番9号"),
    )
    done = I.ingest(rows, before, "import", create_unmatched=False)
    got = {r["row_no"]: (r["outcome"], r["building_id"]) for r in done.results.collect()}
    hits = {1: "m", 2: "m", 3: "z", 4: "m", 8: "m", 9: "n"}
    assert got == {i: ("merged", hits[i]) if i in hits else ("skipped", None) for i in range(1, 13)}
    after = {r["id"]: r for r in done.after.buildings.collect()}
    assert after["m"]["distribution_count"] == 4 and after["m"]["status"] == vocab.CONFIRMED
    assert after["s"]["distribution_count"] == 0 and len(after) == 4
    assert done.after.history.count() == 6


def test_unmatched_past_rows_create_one_building_per_address(spark):
    before = snapshot(spark, [("m", "メゾン丸十", "荒川区西日暮里2-26-10", 0, None, None, None)])
    rows = past(spark, (1, "新館", "荒川区町屋1-1-1"), (2, "別館", "荒川区町屋1-1-1"), (3, "新館", "荒川区町屋1丁目1番1号"))
    done = I.ingest(rows, before, "import")
    got = {r["row_no"]: (r["outcome"], r["building_id"]) for r in done.results.collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["inserted", "merged", "merged"] and len({v[1] for v in got.values()}) == 1
    made = done.after.buildings.filter("id <> 'm'").collect()
    assert len(made) == 1 and made[0]["building_name"] == "新館" and made[0]["distribution_count"] == 3


def test_new_rows(spark):
    m = 0.00001  # 1.1 m north
    before = snapshot(spark, [
        ("served", "配布済ハイツ", "荒川区町屋1-1-1", 2, 35.70, 139.70, None), ("ref", "旧名", "荒川区町屋2-2-2", 0, None, None, "osm:1"),
        ("same", "同名ハイツ", "荒川区町屋3-3-3", 0, 35.71, 139.71, None), ("unnamed", vocab.UNKNOWN_NAME, "荒川区町屋4-4", 0, 35.72, 139.72, "osm:4"),
        ("moved", "移転ハイツ", "荒川区町屋5-5-5", 0, 35.73, 139.73, None), ("dist", "グランドコート日暮里", "荒川区東日暮里3-12", 1, None, None, None),
    ])
    a = "apartments"
    rows = spark.createDataFrame([
        (1, "別の名", "荒川区町屋1丁目1番1号", a, None, None, None, None, None, None),  # served at the address
        (2, "新しい名", "荒川区町屋9-9-9", a, 10, "rental", 35.9, 139.9, "osm:1", None),  # same source id
        (3, "同名ハイツ", "荒川区町屋3-3-3", a, None, None, None, None, "x:3", None),  # same address and name
        (4, "名前あり", "荒川区町屋4-4", a, None, None, 35.72 + 3 * m, 139.72, "x:4", None),  # 3 m, one unnamed
        (5, "名前あり", "荒川区町屋4-4", a, None, None, 35.72 + 7 * m, 139.72, "x:5", None),  # 8 m: another building
        (6, "移転ハイツ", "荒川区町屋六丁目1", a, None, None, 35.73 + 2 * m, 139.73, "x:6", None),  # coordinates elsewhere
        (7, "無関係", "荒川区町屋六丁目2", a, None, None, 35.73 + 2 * m, 139.73, "x:7", None),  # near, other name
        (8, "GRAND COURT NIPPORI", "荒川区東日暮里3-12-5", a, None, None, None, None, "x:8", None),  # possible duplicate
        (9, "佐藤邸", "荒川区町屋8-8", "house", None, None, None, None, "x:9", None),
        (10, "名前あり", "荒川区町屋4-4", a, None, None, 35.80, 139.80, "x:10", None),  # same name, seen in row 5
    ], INPUT)
    done = I.ingest(rows, before, "data_source")
    got = {r["row_no"]: r for r in done.results.collect()}
    assert [got[i]["outcome"] for i in range(1, 11)] == [
        "already_distributed", "merged", "merged", "merged", "inserted", "merged", "inserted", "possible_duplicate", "excluded_use", "merged"]
    assert [got[i]["building_id"] for i in (1, 2, 3, 4, 6)] == ["served", "ref", "same", "unnamed", "moved"]
    assert got[10]["building_id"] == got[5]["building_id"]
    assert "統合しない" in got[7]["near_miss"]
    after = {r["id"]: r for r in done.after.buildings.collect()}
    assert after["ref"]["building_name"] == "旧名" and after["ref"]["total_units"] == 10 and after["ref"]["latitude"] == 35.9
    assert after[got[8]["building_id"]]["status"] == vocab.POSSIBLE
    pair = done.after.candidates.collect()
    assert [(p["new_building_id"], p["possible_existing_building_id"], p["status"]) for p in pair] == [(got[8]["building_id"], "dist", "pending")]
    shown = {r["row_no"]: r["outcome"] for r in I.preview(rows, before).collect()}
    assert shown == {i: got[i]["outcome"] for i in got}

    judged = review.apply_decisions(done.after, done.after.candidates.select("id", F.lit("same").alias("decision")), date(2026, 3, 1))
    row = judged.buildings.filter(F.col("id") == got[8]["building_id"]).first()
    assert row["status"] == vocab.CONFIRMED and row["last_distributed_date"] == date(2025, 5, 5)


def test_reconcile_confirms_and_sets_aside(spark):
    before = snapshot(spark, [
        ("a", "甲ハイツ", "荒川区町屋1-1-1", 1, None, None, None), ("b", "乙ハイツ", "荒川区町屋1丁目1番1号", 0, None, None, None),
        ("c", "グランドコート", "荒川区町屋2-2", 1, None, None, None), ("d", "GRAND COURT", "荒川区町屋2-2-2", 0, None, None, None), ("e", "丙", "荒川区町屋9-9-9", 0, None, None, None),
    ])
    done = I.reconcile(before, spark.createDataFrame([("荒川区",), (None,)], "city string"))
    status = {r["id"]: r["status"] for r in done.after.buildings.collect()}
    assert status == {"a": vocab.CONFIRMED, "b": vocab.CONFIRMED, "c": vocab.CONFIRMED, "d": vocab.POSSIBLE, "e": vocab.NOT_DISTRIBUTED}
    assert done.counts.first().asDict() == {"confirmed": 1, "possible_duplicate": 1}
    different = done.after.candidates.withColumn("status", F.lit("different"))
    again = I.reconcile(I.Snapshot(before.buildings, before.history, different), spark.createDataFrame([("荒川区",)], "city string"))
    assert {r["id"]: r["status"] for r in again.after.buildings.collect()}["d"] == vocab.NOT_DISTRIBUTED


@pytest.mark.parametrize("partitions", [1, 7])
def test_batch_resolution_does_not_depend_on_partitions(spark, partitions):
    rows = [(i, "松竹梅"[i % 3] + "ハイツ", f"荒川区町屋1-{i % 4}", "apartments", None, None, None, None, f"x:{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, INPUT).repartition(partitions)
    done = I.preview(df, snapshot(spark, [("q", "遠い", "北区王子1-1-1", 0, None, None, None)]))
    kept = sorted(r["row_no"] for r in done.collect() if r["outcome"] == "inserted")
    first = {}
    for i in range(40):
        first.setdefault((i % 3, i % 4), i)
    assert kept == sorted(first.values())
