from datetime import date

from pyspark.sql import functions as F

from meguri.functions import parse, vocab
from meguri.functions.use import with_use
from meguri.operators.quality import prepare_rows

INCLUDED = [
    ("グランドヒルズ荒川", "apartments"), ("日暮里ハウジング", "housing"), ("サンライトマンション荒川", "マンション"), ("コーポ東尾久", "アパート"),
    ("都営南千住住宅", "集合住宅"), ("西日暮里共同住宅", "共同住宅"), ("上野桜木アパートメント", "apartments"), ("荒川メゾンひぐらし", ""),
    ("南千住レジデンス", "residential"),
]
EXCLUDED = [
    ("佐藤邸", "house"), ("西尾久の一戸建て", "detached"), ("尾久ツインハウス", "semidetached_house"), ("町屋テラスハウス", "terrace"),
    ("日暮里ドミトリー", "dormitory"), ("荒川第一社宅", "社宅"), ("田中様邸", "戸建て"), ("谷中の一軒家", "一軒家"), ("町屋長屋", "長屋"),
    ("町屋ショッピングセンター", "commercial"), ("南千住ドラッグストア", "retail"), ("町屋銀座ストア", "店舗"), ("店舗付きマンション日暮里", "店舗付き住宅"),
    ("日暮里オフィスタワー", "office"), ("荒川区役所別館", "事務所"), ("東日暮里製作所", "factory"), ("東尾久金属工業", "工場"),
    ("荒川物流センター", "warehouse"), ("南千住倉庫3号棟", "倉庫"), ("荒川第二小学校", "school"), ("南千住総合病院", "hospital"),
    ("日暮里クリニックビル", "病院"), ("町屋パーキング", "garage"), ("西尾久駐車場", "駐車場"),
]
UNKNOWN = [("西日暮里A棟", "yes"), ("山田ビル", "")]


def test_use_classification(spark):
    df = spark.createDataFrame(INCLUDED + EXCLUDED + UNKNOWN, "name string, value string")
    rows = {r["name"]: r["use"] for r in with_use(df, "value", "name").collect()}
    assert all(rows[n]["use"] == "RESIDENTIAL_MULTI" for n, _ in INCLUDED)
    assert all(rows[n]["use"] == "EXCLUDED" and not rows[n]["unknown"] for n, _ in EXCLUDED)
    assert all(rows[n]["use"] == "EXCLUDED" and rows[n]["unknown"] for n, _ in UNKNOWN)
    assert "レジデンス" in rows["南千住レジデンス"]["reason"]


def test_values(spark):
    one = spark.createDataFrame([("1,200戸", "不明", "１２世帯", "約30", "2026年3月5日", "2026/13/1")], "a string, b string, c string, d string, e string, f string")
    r = one.select(
        parse.count_of_source(F.col("a")).alias("a"), parse.count_of_source(F.col("b")).alias("b"), parse.count_of_import(F.col("c")).alias("c"),
        parse.count_of_research(F.col("d")).alias("d"), parse.date_of_import(F.col("e")).alias("e"), parse.date_of_import(F.col("f")).alias("f"),
        parse.coordinate(F.lit("NaN"), "latitude").alias("nan"), parse.coordinate(F.lit("91"), "latitude").alias("far"),
        parse.research_source(F.lit("Google Maps")).alias("s"), parse.research_source(F.lit("ブログ")).alias("s2"),
        parse.property_type_of_research(F.lit("賃貸・分譲")).alias("t"), parse.dataset_id(F.lit("/x/荒川 区(1).csv")).alias("ds"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["e"], r["f"], r["nan"], r["far"]) == (1200, None, 12, date(2026, 3, 5), None, None, None)
    assert r["d"]["value"] is None and "数値ではありません" in r["d"]["error"]
    assert r["s"]["value"] == "google_maps" and "使えません" in r["s2"]["error"]
    assert r["t"]["value"] is None and "両方" in r["t"]["error"] and r["ds"] == "荒川-区-1"


def test_admissible_rows(spark):
    past = {"distributed_date": date(2026, 1, 1), "distributed_by": None, "notes": None}
    rows = [
        (1, "", "", None, None, past), (2, "メゾン丸十", "", None, None, past), (3, "メゾン丸十", "", None, None, None),
        (4, "佐藤邸", "荒川区町屋1-2", "house", None, None), (5, "佐藤邸", "荒川区町屋1-2", "house", None, past),
        (6, "ハイツA", "荒川区町屋1-2", None, "mock:1", None), (7, vocab.UNKNOWN_NAME, "荒川区町屋1-2", "apartments", "osm:1", None),
    ]
    df = spark.createDataFrame(rows, "row_no long, building_name string, address string, building_use_raw string, source_ref string, "
                               "distribution struct<distributed_date:date,distributed_by:string,notes:string>")
    got = {r["row_no"]: r for r in prepare_rows(df).collect()}
    assert [got[i]["rejected"] for i in range(1, 8)] == ["skipped", None, "skipped", "excluded_use", None, "skipped", None]
    assert got[7]["name_key"] == "建物名不明#osm:1"
