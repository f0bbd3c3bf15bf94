import pytest
from pyspark.sql import functions as F

from meguri.functions import names as N
from meguri.functions import similarity as S
from meguri.operators import joins as J

# (a, b, score): the stated measurements, and bounds where only bounds are stated.
MEASURED = [
    ("コスモステージ荒川遊園 S棟", "コスモステージ荒川遊園 N棟", 0.947), ("ノーザンスクエア", "サザンスクエア", 0.818),
    ("グリーンコーポ町屋", "グリーンパーク町屋", 0.845), ("メゾンドブルー", "メゾンひぐらし", 0.776),
    ("サンハイム南千住", "リバーサイド南千住", 0.706), ("第一荒川ハイツ", "荒川第三マンション", 0.553),
    ("グランドメゾン中野", "GRAND MAISON NAKANO", 0.854), ("グランドメゾン中野", "グランドメゾン新宿", 0.950),
    ("グランドメゾン日暮里", "GRAND MAISON NIPPORI", 1.0), ("サンライズ", "SUNRISE", 1.0), ("コーポ東尾久", "コーポ東尾久", 1.0),
    ("グランドコート日暮里", "GRAND COURT NIPPORI", 1.0), ("ヴィラ日暮里", "ビラ日暮里", 1.0),
    ("", "GRAND MAISON", 0.0), (None, None, 0.0),
]


@pytest.fixture(scope="module")
def scores(spark):
    pairs = [(a, b) for a, b, _ in MEASURED] + [("メゾンドソレイユ", "MAISON DE SOLEIL"), ("グランドメゾン日暮里", "さくらハイツ町屋")]
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    rows = df.select("i", N.name_features(F.col("p.a")).alias("x"), N.name_features(F.col("p.b")).alias("y"))
    out = rows.withColumn("s", S.name_similarity(F.col("x"), F.col("y"))).orderBy("i").collect()
    return dict(zip(pairs, [r["s"] for r in out]))


def test_measured_scores(scores):
    for a, b, expected in MEASURED:
        assert round(scores[a, b]["score"], 3) == expected, (a, b)


def test_bounds_and_flags(scores):
    assert scores["メゾンドソレイユ", "MAISON DE SOLEIL"]["score"] > 0.6
    assert scores["グランドメゾン日暮里", "さくらハイツ町屋"]["score"] < 0.5
    assert scores["グランドメゾン日暮里", "GRAND MAISON NIPPORI"]["translit"]
    assert not scores["コーポ東尾久", "コーポ東尾久"]["translit"]


def test_tokens_and_surface(spark):
    df = spark.createDataFrame([("グランドメゾン日暮里",), ("GRAND MAISON NIPPORI",), ("ﾒｿﾞﾝ丸十101号室",), ("サンマンション２号棟",), ("ＭＥＺＯＮ・丸十",)], "building_name string")
    rows = {r["building_name"]: r["name"] for r in N.with_name(df).collect()}
    assert rows["グランドメゾン日暮里"]["tokens"] == rows["GRAND MAISON NIPPORI"]["tokens"] == ["grand", "maison", "nippori"]
    assert rows["ﾒｿﾞﾝ丸十101号室"]["normalized"] == "メゾン丸十"
    assert rows["サンマンション２号棟"]["tokens"] == ["sun"]
    assert rows["ＭＥＺＯＮ・丸十"]["normalized"] == "mezon丸十"


def test_romanization(spark):
    df = spark.createDataFrame([("キャッスル",), ("マッチ",), ("ショッピング",), ("トウキョウ",), ("ッア",)], "a string")
    got = {r["a"]: r["r"] for r in df.select("a", N.katakana_to_romaji(F.col("a")).alias("r")).collect()}
    assert got == {"キャッスル": "kyassuru", "マッチ": "matchi", "ショッピング": "shoppingu", "トウキョウ": "toukyou", "ッア": "a"}
    table = N._KANA
    assert table["シ"] == "shi" and table["ジェ"] == "je" and table["リャ"] == "rya" and len(table) > 120


def test_pair_helpers(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("DIXON", "DICKSONX"), ("", ""), ("a", ""), ("ab", "ab")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", S.jaro_winkler(a, b).alias("jw"), S.levenshtein_ratio(a, b).alias("lev"), S.bigram_dice(a, b).alias("dice")).collect()
    assert [round(r["jw"], 4) for r in rows] == [0.9611, 0.84, 0.8133, 1.0, 0.0, 1.0]
    assert [round(r["lev"], 4) for r in rows] == [0.6667, 0.6667, 0.5, 1.0, 0.0, 1.0]
    assert [round(r["dice"], 4) for r in rows] == [0.4, 0.2222, 0.3636, 1.0, 0.0, 1.0]
    arrays = spark.createDataFrame([(["x", "x", "y"], ["x", "z"]), ([], []), (["x"], ["x", "y"])], "a array<string>, b array<string>")
    got = arrays.select(S.token_dice(a, b).alias("d"), S.is_token_prefix(a, b).alias("p")).collect()
    assert [(r["d"], r["p"]) for r in got] == [(0.4, False), (1.0, False), (2 / 3, True)]


def test_a_piece_is_romanized_once(spark):
    df = spark.createDataFrame([("Customer#12",), ("K-2 ß１",), ("サンABC－ッー",), ("丸十",), ("",), (None,)], "a string")
    cut = df.select("a", N.tokens(F.col("a")).alias("t"), N.katakana_to_romaji(F.col("a")).alias("r"))
    plan = df.select(N.tokens(F.col("a")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[^a-z0-9]") == 1
    got = {r["a"]: (r["t"], r["r"]) for r in cut.collect()}
    assert got["Customer#12"] == (["kustomer12"], "Customer#12")
    assert got["丸十"] == (["丸十"], "丸十") and got[""] == ([], "") and got[None] == (None, None)
    assert got["K-2 ß１"][1] == "K2 ß１" and got["サンABC－ッー"][1] == "sanABC"


@pytest.mark.parametrize("paired", [2, 1024])
def test_pairs_of_one_name(spark, monkeypatch, paired):
    """Every two rows of one canonical name, whatever the block they lie in, as by scoring each pair of rows."""
    monkeypatch.setattr(J, "PAIRED", paired)
    said = ["グランドメゾン１", "GRAND MAISON 1", "grand maison1", "サンハイツ", "SUN Heights", "マンション", "アパート", "", None, "丸十"]
    rows = [(i, said[i * i % 10]) for i in range(60)] + [(3, "サンハイツ"), (3, "サンハイツ"), (4, "SUN Heights"), (None, "丸十")]
    named = N.with_name(spark.createDataFrame(rows, "building_id long, name string"), "name", "f").select("building_id", "f").cache()
    score = lambda f, g: S.name_similarity(f, g)["score"]
    other = named.select(F.col("building_id").alias("other_id"), F.col("f").alias("g"))
    every = named.join(other, (F.col("f.canonical") == F.col("g.canonical")) & (F.col("building_id") < F.col("other_id")))
    want = sorted(tuple(r) for r in every.select("building_id", "other_id", score(F.col("f"), F.col("g"))).collect())
    got = sorted(tuple(r) for r in J.same_name_pairs(named, score).select("building_id", "other_id", "score").collect())
    assert len(want) > 300 and {s for _, _, s in want} > {1.0}
    assert got == want
