from pyspark.sql import functions as F

from meguri.operators.quality import check_completion_rows
from meguri.plans import names as N


def test_verdicts(spark):
    """Own coordinates; a hundred thousandth of a degree of latitude is 1.1 m."""
    north = lambda steps: 35.5 + steps / 100_000
    targets = [
        ("alone", "A", north(0)), ("crowd", "B", north(0)), ("far", "C", north(0)), ("none", "D", north(0)),
        ("left", "E", north(0)), ("right", "E", north(20)), ("a", "F", north(0)), ("b", "F", north(300)), ("even", "G", north(0)), ("same", "H", north(0)),
    ]
    candidates = [
        ("A", "杉の館", "山手町1-1-1", north(8)), ("B", "柏コーポ", "山手町2-1-1", north(7)), ("B", "楠コーポ", "山手町2-1-2", north(9)),
        ("C", "椿邸", "山手町3-1", north(45)), ("E", "藤ハイム", "山手町5-1-1", north(4)), ("F", "北の家", "山手町6-1-1", north(2)),
        ("F", "南の家", "山手町6-2-1", north(302)), ("G", "桐荘", "山手町7-1-1", north(18)), ("G", "榎荘", "山手町7-1-2", north(-20)),
        ("H", "甲", "1", north(0)), ("H", "乙", "2", north(0)),
    ]
    t = spark.createDataFrame([(*x, 139.6) for x in targets], "id string, block_key string, latitude double, longitude double")
    c = spark.createDataFrame([(*x, 139.6) for x in candidates], "block_key string, name string, address string, latitude double, longitude double").withColumn("source", F.lit("archive"))
    got = {r["id"]: r for r in N.match_names(t, c).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {
        "alone": "HIGH", "crowd": "AMBIGUOUS", "far": "AMBIGUOUS", "none": "NOT_FOUND", "left": "AMBIGUOUS", "right": "AMBIGUOUS",
        "a": "HIGH", "b": "HIGH", "even": "AMBIGUOUS", "same": "HIGH"}
    assert got["alone"]["name"] == "杉の館" and got["a"]["name"] == "北の家" and got["b"]["name"] == "南の家"
    assert "近すぎます" in got["crowd"]["reason"] and "別の建物も" in got["left"]["reason"] and got["far"]["name"] is None
    assert len(got["even"]["alternatives"]) == 2 and got["none"]["alternatives"] == []
    distances = [x["distance"] for x in got["even"]["alternatives"]]
    assert distances == sorted(distances)


def test_rings_find_the_same_neighbours_as_all_pairs(spark):
    import math
    import random
    rng = random.Random(4)
    point = lambda: (35.7 + rng.random() * 0.004, 139.7 + rng.random() * 0.02)
    t = [(str(i), "b", *point()) for i in range(40)]
    c = [("b", f"n{i:02d}", "x", "s", *point()) for i in range(60)]
    got = {}
    tdf = spark.createDataFrame(t, "id string, block_key string, latitude double, longitude double")
    cdf = spark.createDataFrame(c, "block_key string, name string, address string, source string, latitude double, longitude double")
    for r in N.nearest_in_block(tdf, cdf, 3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["candidate"]["name"])

    def metres(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {i: [x[1] for x in sorted(c, key=lambda x: metres((la, lo), x[4:]))[:3]] for i, _, la, lo in t}


CURRENT = "id string, address string, building_name string, normalized_address string, normalized_building_name string, name_source string"


def _current(spark):
    return spark.createDataFrame([
        ("a1", "荒川区東日暮里1-1", "（建物名不明）", "荒川区東日暮里1-1", "建物名不明", None), ("a2", "荒川区東日暮里1-1", "既存ハイツ", "荒川区東日暮里1-1", "既存ハイツ", None),
        ("a3", "荒川区東日暮里1-2", None, "荒川区東日暮里1-2", "", None), ("b1", "荒川区東日暮里2-1", "同名荘", "荒川区東日暮里2-1", "同名荘", None)], CURRENT)


def test_name_list(spark):
    cols = "line long, building_id string, address string, building_name string, status string, source string, note string"
    rows = [(1, "a1", "", "新ハイツ", "high", "homes", ""), (2, "a2", "", "別名", "CONFIRMED", "homes", ""), (3, "a3", "", "推測荘", "AMBIGUOUS", "", ""), (4, "b1", "", "同名荘", "HIGH", "", "")]
    done = N.apply_name_list(_current(spark), check_completion_rows(spark.createDataFrame(rows, cols)))
    assert {r["id"]: r["error"] for r in done.results.collect()} == {"a1": None, "a2": "既存名あり", "a3": "確度が不足", "b1": "同じ名前で更新済み"}
    after = {r["id"]: r for r in done.buildings.collect()}
    assert after["a1"]["building_name"] == "新ハイツ" and after["a1"]["name_source"] == "csv" and after["a2"]["building_name"] == "既存ハイツ"
    assert done.updates.count() == 1
    bad = rows + [(5, "a1", "", "重複", "HIGH", "", ""), (6, "", "", "x", "HIGH", "", ""), (7, "zz", "", "x", "maybe", "", ""), (8, "yy", "", "", "HIGH", "", "")]
    checked = check_completion_rows(spark.createDataFrame(bad, cols))
    errors = {r["line"]: r["error"] for r in checked.collect() if r["error"]}
    assert "1 行目と重複" in errors[5] and "空です" in errors[6] and "MAYBE" in errors[7] and "building_name が空" in errors[8]
    refused = N.apply_name_list(_current(spark), checked)
    assert refused.updates.count() == 0 and {r["id"]: r["building_name"] for r in refused.buildings.collect()}["a1"] == "（建物名不明）"


def test_edits(spark):
    edits = spark.createDataFrame([("a1", "既存 ハイツ"), ("a3", " 手入力 "), ("b1", "")], "id string, building_name string")
    done = N.edit_names(_current(spark), edits)
    errors = {r["id"]: r["error"] for r in done.results.collect()}
    assert "既に登録" in errors["a1"] and errors["a3"] is None and "入力してください" in errors["b1"]
    row = done.buildings.filter("id = 'a3'").first()
    assert (row["building_name"], row["normalized_building_name"], row["name_source"]) == ("手入力", "手入力", "manual")
