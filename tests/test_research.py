import pytest
from pyspark.sql import functions as F

from meguri.operators.quality import check_research_rows
from meguri.plans import research as R

CUR = "id string, building_name string, address string, normalized_address string, normalized_building_name string, prefecture string, city string, total_units int, property_type string, building_type string, status string, distribution_count long, source string, name_source string"
U = "（建物名不明）"
BASE = "東京都荒川区東日暮里3丁目12"


def current(spark, *rows):
    """rows: id, name, address, units, type"""
    full = [(i, n, a, "", "", "東京都", "荒川区", u, t, None, "NOT_DISTRIBUTED", 0, "data_source", None) for i, n, a, u, t in rows]
    return spark.createDataFrame(full, CUR)


def sheet(spark, *rows):
    """rows: id, name, address, units, type, source"""
    full = [(i + 1, *r[:5], "", r[5] if len(r) > 5 else "chatgpt", "") for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "line long, building_id string, building_name string, address string, total_units string, property_type string, building_type string, source string, note string")
    return check_research_rows(df)


@pytest.fixture(scope="module")
def plan(spark):
    rows = [
        ("b1", "○○マンション", "", "", ""), ("b2", "新しい名前", "", "", ""), ("b3", "", "東京都荒川区東日暮里3丁目12番5号", "", ""),
        ("b4", "", "東京都荒川区西日暮里3丁目12番5号", "", ""), ("b5", "", "", "32", ""), ("b6", "", "", "約30", ""), ("b7", "", "", "", "賃貸"),
        ("b8", "既存", "", "32", "分譲マンション"), ("zzz", "○○マンション", "", "", ""), ("", "名", "", "", ""),
        ("", "単独", "荒川区南千住1-1", "", ""), ("", "東棟", "荒川区南千住2-2", "", ""), ("", "他の棟", "荒川区南千住2-2", "", ""),
        ("", "号まで", "荒川区南千住3-3-5", "", ""), ("", "別の号", "荒川区南千住4-4-5", "", ""), ("", "新築", "荒川区南千住九丁目9-1", "8", ""),
        ("", "小さい", "荒川区南千住9-8-1", "5", ""), ("b9", "", "", "12", "", "ブログ"), ("b1", "重複", "", "", ""),
    ]
    stored = current(
        spark, *[(f"b{i}", U, f"東京都荒川区東日暮里3丁目1{i}", None, "unknown") for i in (1, 5, 6, 7, 9)], ("b2", "既存マンション", "荒川区町屋1-1", None, "unknown"),
        ("b3", U, BASE, None, "unknown"), ("b4", U, "東京都荒川区東日暮里4丁目12", None, "unknown"), ("b8", "既存", "荒川区町屋1-8", 32, "condominium"),
        ("k1", U, "荒川区南千住一丁目1", None, "unknown"), ("k2", "東棟", "荒川区南千住2-2", None, "unknown"), ("k3", "西棟", "荒川区南千住2丁目2", None, "unknown"),
        ("k4", U, "荒川区南千住3-3", None, "unknown"), ("k5", U, "荒川区南千住4-4-9", None, "unknown"))
    checked = sheet(spark, *rows)
    errors = {r["line"]: r["error"] for r in checked.collect() if r["error"]}
    assert list(errors) == [19] and "1 行目" in errors[19]
    planned = R.plan_research(checked.filter("error is null").drop("error"), stored, allow_create=True)
    return stored, planned.cache()


def test_verdicts(plan):
    got = {r["line"]: r for r in plan[1].collect()}
    assert [got[i]["verdict"] for i in range(1, 19)] == [
        "更新可能", "建物名競合", "更新可能", "住所競合", "更新可能", "要確認", "更新可能", "変更なし", "照合不可", "照合不可",
        "更新可能", "変更なし", "要確認", "更新可能", "新規登録", "新規登録", "照合不可", "要確認"]
    assert [(c["field"], c["old_value"], c["new_value"]) for c in got[5]["changes"]] == [("total_units", None, "32")]
    assert [(c["field"], c["old_value"], c["new_value"]) for c in got[7]["changes"]] == [("property_type", "unknown", "rental")]
    assert got[2]["changes"] == [] and got[8]["changes"] == []
    assert [got[i]["matched_id"] for i in (11, 12, 13, 14)] == ["k1", "k2", None, "k4"]
    assert [got[i]["match_kind"] for i in (1, 11, 12, 13, 14, 15, 16)] == [
        "id", "address_one", "address_many", "address_many", "block_prefix_one", "block_no_prefix", "block_absent"]


def test_apply_then_roll_back(spark, plan):
    stored, planned = plan
    done = R.apply_research(stored, planned, planned.select("line"), "batch")
    after = {r["id"]: r for r in done.buildings.collect()}
    assert after["b1"]["building_name"] == "○○マンション" and after["b1"]["name_source"] == "csv" and after["b5"]["total_units"] == 32
    assert after["b3"]["address"].endswith("12番5号") and after["b3"]["normalized_address"] == "荒川区東日暮里3-12-5"
    assert done.counts.first().asDict() == {"applied": 6, "created": 2} and len(after) == 16
    made = sorted((r["building_name"], r["city"], r["prefecture"], r["total_units"]) for i, r in after.items() if len(i) > 10)
    assert made == [("別の号", "荒川区", "東京都", None), ("新築", "荒川区", "東京都", 8)]
    back = R.roll_back(done.buildings, done.audit, "batch").join(stored.select("id"), "id", "left_semi")
    keep = ["id", "building_name", "address", "total_units", "property_type", "building_type", "status"]
    assert sorted(map(tuple, back.select(*keep).collect())) == sorted(map(tuple, stored.select(*keep).collect()))


def test_overwrite_replaces_names(spark):
    rows = sheet(spark, ("b1", "新しい名前", "", "", "")).drop("error")
    planned = R.plan_research(rows, current(spark, ("b1", "既存", BASE, None, "unknown")), overwrite=True).first()
    assert planned["verdict"] == "更新可能" and planned["changes"][0]["old_value"] == "既存" and "上書き" in planned["reasons"][-1]


def test_address_decisions(spark):
    cases = [("東京都荒川区東日暮里3丁目12番5号", "detail"), ("東京都荒川区東日暮里3-12", "none"), ("東京都荒川区西日暮里3丁目12番5号", "conflict"),
             ("東京都荒川区東日暮里4丁目12番5号", "conflict"), ("東京都荒川区東日暮里3丁目13番5号", "conflict"), ("", "none"), ("東京都荒川区", "conflict")]
    df = spark.createDataFrame(cases, "a string, kind string")
    done = R.with_address_decision(df.withColumn("old", F.lit(BASE)), "old", "a", "d")
    assert all(r["d"]["kind"] == r["kind"] for r in done.collect())
