import pytest
from pyspark.sql import functions as F

from meguri.functions import address as P

TARGET = "荒川区東日暮里1-5-3"
SPELLINGS = [
    "東京都荒川区東日暮里1丁目5番3号", "東京都荒川区東日暮里1-5-3", "荒川区東日暮里１－５－３",
    "荒川区 東日暮里 1-5-3", "荒川区東日暮里一丁目五番三号", "東京都　荒川区　東日暮里１丁目５番３号",
]


def _normal(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, address string")
    return [r["addr"] for r in P.with_address(df).orderBy("i").collect()]


def test_spellings_share_one_form(spark):
    assert {a["normalized"] for a in _normal(spark, SPELLINGS)} == {TARGET}


def test_extra_text_and_odd_forms(spark):
    named, sapporo, none, blank, town, teens, bad = _normal(spark, [
        "荒川区東日暮里1-5-3 グランドメゾン日暮里 101号室", "北海道札幌市北区北12条西4丁目1", None, "   ",
        "荒川区三軒茶屋十一丁目二番", "荒川区西日暮里二十三丁目十番", "荒川区西日暮里一二十丁目",
    ])
    assert named["normalized"] == TARGET and "メゾン" in named["extra"] and named["blocks"] == [1, 5, 3]
    assert sapporo["extra"] == "" and sapporo["normalized"] == "札幌市北区北12-西4-1" and sapporo["prefecture"] == "北海道"
    assert none["normalized"] == blank["normalized"] == "" and none["blocks"] == []
    assert town["normalized"] == "荒川区三軒茶屋11-2"
    assert teens["blocks"] == [23, 10]
    assert bad["normalized"] == "荒川区西日暮里一二十丁目"


def test_column_and_table_forms_agree(spark):
    df = spark.createDataFrame([(x,) for x in SPELLINGS + ["①丁目 荒川区", "ｱﾗｶﾜ区1丁目"]], "address string")
    both = P.with_address(df).withColumn("same", F.col("addr") == P.normalize_address(F.col("address")))
    assert all(r["same"] for r in both.collect())


@pytest.mark.parametrize("text, expected", [
    ("東京都荒川区東日暮里1-5-3", ("東京都", "荒川区", "東日暮里")),
    ("荒川区東日暮里1-5-3", (None, "荒川区", "東日暮里")),
    ("北海道虻田郡倶知安町北1条東1-1", ("北海道", "虻田郡倶知安町", "北")),
    ("番地なし", (None, None, "番地なし")),
])
def test_parts(spark, text, expected):
    row = spark.createDataFrame([(text,)], "a string").select(P.address_parts(F.col("a")).alias("p")).first()["p"]
    assert tuple(row) == expected


def test_block_keys(spark):
    cases = {
        "東京都荒川区東日暮里三丁目12": "荒川区/東日暮里/3/12", "東京都荒川区東日暮里3-12-5": "荒川区/東日暮里/3/12",
        "神奈川県横浜市西日暮里2-26": "横浜市/西日暮里/2/26", "埼玉県三芳町上富1-2": "三芳町/上富/1/2",
        "東京都荒川区町屋1-2": "荒川区/町屋/1/2", "荒川区西日暮里十一丁目４２": "荒川区/西日暮里/11/42",
        "東京都荒川区東日暮里": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r["a"]: r["k"] for r in df.select("a", P.block_key_text(F.col("a")).alias("k")).collect()}
    assert got == cases


def test_canonical_and_city(spark):
    df = spark.createDataFrame([("東京都荒川区西日暮里二丁目26番10号",), ("荒川区西日暮里２ー２６ー１０",)], "a string")
    rows = df.select(P.canonical_address(F.col("a")).alias("c"), P.city_of(F.col("a")).alias("city")).collect()
    assert {r["c"] for r in rows} == {"荒川区西日暮里2-26-10"}
    assert [r["city"] for r in rows] == ["荒川区", "荒川区"]


def test_prefecture_is_filled_only_when_unique(spark):
    master = {"甲県": ["北区", "東区"], "乙県": ["北区"]}
    df = spark.createDataFrame([("東区", None), ("北区", None), ("北区", "丙県"), (None, None)], "city string, prefecture string")
    rows = P.with_prefecture_backfill(df, master=master).collect()
    assert [r["prefecture"] for r in rows] == ["甲県", None, "丙県", None]
