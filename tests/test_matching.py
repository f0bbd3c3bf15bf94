"""Duplicate matching against a plain all-pairs evaluation of the rule."""

import random

import pytest
from pyspark.sql import functions as F

from meguri.functions import geo
from meguri.functions.address import with_address
from meguri.functions.names import with_name
from meguri.functions.similarity import address_similarity, name_similarity
from meguri.operators import matching as M

SCHEMA = "id string, building_name string, address string, latitude double, longitude double"


def _brute_force(t, e, top, divergent=0.85):
    """The rule over every pair, with none of the keys."""
    side = lambda df, p: with_name(with_address(df)).select(
        F.col("id").alias(p), F.struct("addr", "name", "latitude", "longitude").alias(p + "r"))
    pairs = side(t, "t").crossJoin(side(e, "e")).filter("t <> e")
    pairs = pairs.withColumns({
        "a": address_similarity(F.col("tr.addr"), F.col("er.addr")), "n": name_similarity(F.col("tr.name"), F.col("er.name")),
        "m": geo.distance_m(F.col("tr.latitude"), F.col("tr.longitude"), F.col("er.latitude"), F.col("er.longitude")),
    }).select("t", "e", "a.*", F.col("n.score").alias("name"), "m").collect()
    need = {"equal": 0.0, "prefix": 0.45, "divergent": divergent, "unknown": 0.60}
    found = {}
    for r in pairs:
        local = r["locality_match"] and r["name"] >= need[r["relation"]]
        near = r["m"] is not None and (r["m"] <= 10 or (r["m"] <= 30 and r["name"] >= 0.5))
        if r["exact"] or local or near:
            found.setdefault(r["t"], []).append((r["exact"], -r["score"], -r["name"], r["e"]))
    out = {}
    for target, rows in found.items():
        sure = sorted(x[3] for x in rows if x[0])
        out[target] = sure[:1] if sure else [x[3] for x in sorted(rows, key=lambda x: x[1:])][:top]
    return out


def _random_rows(prefix, n, rng):
    wards, words = ["荒川区東日暮里", "東日暮里", "荒川区西日暮里", "台東区谷中", ""], ["グランド", "SUN", "ロイヤル", "コーポ", "メゾン", "ハイツ", "PARK", "さくら", "丸十"]
    rows = []
    for i in range(n):
        blocks = "-".join(str(rng.randint(1, 3)) for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 3])))
        name = rng.choice([None, ""]) if rng.random() < 0.05 else "".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "2", "Ⅱ", " S棟"])
        placed = rng.random() < 0.7
        lat = 35.73 + rng.randint(0, 12) * 0.00006 if placed else None
        rows.append((f"{prefix}{i:03d}", name, rng.choice(wards) + blocks, lat, 139.78 + rng.randint(0, 8) * 0.00007 if placed else None))
    return rows


@pytest.mark.parametrize("top, seed, crowd", [(None, 2, 3), (2, 3, 200)])
def test_keys_lose_no_pair(spark, monkeypatch, top, seed, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)  # 3: nearly every key counts as crowded
    rng = random.Random(seed)
    existing = _random_rows("e", 60, rng)
    targets = spark.createDataFrame(_random_rows("t", 60, rng) + existing[:5], SCHEMA)
    existing = spark.createDataFrame(existing, SCHEMA)
    got = {}
    for r in M.match_candidates(targets, existing, top).orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["existing_id"])
    assert got == _brute_force(targets, existing, top)


def test_names_of_common_words(spark, monkeypatch):
    """Names without a canonical form keep their pairs in crowded keys, and differ from each other."""
    names = ["マンション", "アパート", "ビルディング", "マンション", "荒川マンション"]
    existing = spark.createDataFrame([(f"e{i:03d}", names[i % 5], f"荒川区町屋{i % 4 + 1}-{i}-1", None, None) for i in range(250)], SCHEMA)
    targets = spark.createDataFrame([(f"t{i}", n, "荒川区町屋9-99-9", None, None) for i, n in enumerate(names)], SCHEMA)
    got = {}
    for crowd in (3, 200):
        monkeypatch.setattr(M, "CROWD", crowd)
        for r in M.match_candidates(targets, existing, None).collect():
            got.setdefault((crowd, r["target_id"]), set()).add(r["existing_id"])
    want = {t: set(e) for t, e in _brute_force(targets, existing, None).items()}
    assert min(len(e) for e in want.values()) >= 50
    for crowd in (3, 200):
        assert {t: got[c, t] for c, t in got if c == crowd} == want


@pytest.mark.parametrize("score", [0.5, 0.75, 0.9])
def test_keys_hold_for_other_thresholds(spark, monkeypatch, score):
    monkeypatch.setattr(M, "CROWD", 3)
    rng = random.Random(8)
    existing = spark.createDataFrame(_random_rows("e", 50, rng), SCHEMA)
    targets = spark.createDataFrame(_random_rows("t", 40, rng), SCHEMA)
    found = M.match_candidates(targets, existing, None, M.Thresholds(divergent_name=score)).collect()
    got = {}
    for r in found:
        got.setdefault(r["target_id"], set()).add(r["existing_id"])
    assert got == {t: set(e) for t, e in _brute_force(targets, existing, None, score).items()}


def test_stated_cases(spark):
    t = [
        ("1", "GRAND MAISON NIPPORI", "荒川区東日暮里1-5-3", None, None), ("2", "GRAND COURT NIPPORI", "北区東日暮里3-12-5", None, None),
        ("3", "SUNRISE", "港区西日暮里5-5-5", 35.74, 139.79), ("4", "グランドメゾン日暮里", "西日暮里1-5-3", None, None),
        ("5", "GRAND MAISON", "台東区下谷2-1-1", 35.72951, 139.78021), ("6", "さくらハイツ", "荒川区東日暮里9-9-9", None, None),
    ]
    e = [
        ("a", "グランドメゾン日暮里", "東京都荒川区東日暮里1丁目5番3号", None, None), ("b", "A", "北区東日暮里3-12-9", None, None),
        ("c", "グランドコート日暮里", "北区東日暮里3-12", None, None), ("d", "サンライズ", "港区東日暮里1-1-1", 35.7295, 139.7802),
        ("f", "グランドメゾン日暮里", "荒川区西日暮里1-5-3", None, None), ("6", "さくらハイツ", "荒川区東日暮里9-9-9", None, None),
    ]
    t, e = spark.createDataFrame(t, SCHEMA), spark.createDataFrame(e, SCHEMA)
    found = M.match_candidates(t, e).cache()
    rows = {(r["target_id"], r["rank"]): r for r in found.collect()}
    status = {r["id"]: (r["status"], r["matched_id"]) for r in M.match_verdicts(t, found).collect()}
    assert status["1"] == ("CONFIRMED_DISTRIBUTED", "a") and "住所完全一致" in rows["1", 1]["reasons"][0]
    assert rows["1", 1]["distance_meters"] is None
    assert status["2"][0] == "POSSIBLE_DUPLICATE" and rows["2", 1]["existing_id"] == "c" and rows["2", 1]["name_score"] > 0.9
    assert "住所部分一致" in " ".join(rows["2", 1]["reasons"])
    assert status["3"] == ("NOT_DISTRIBUTED", None)
    assert status["4"][0] == "POSSIBLE_DUPLICATE"
    assert "座標距離" in " ".join(rows["5", 1]["reasons"])
    assert status["6"][0] == "NOT_DISTRIBUTED"  # not matched with itself


def test_a_crowded_spot_is_scored_for_the_best_only(spark, monkeypatch):
    """Many served rows at one spot: the best of each target as by all pairs, while few pairs have their names scored."""
    rng = random.Random(4)
    wards = ["荒川区東日暮里", "台東区谷中", "台東区谷中一", "北区田端", "架空区桜町", "東日暮里", ""]
    names = ["グランド", "SUN", "ロイヤル", "コーポ", "メゾン", "ハイツ", "PARK", "さくら", "丸十"]
    row = lambda i, side: (f"{side}{i:03d}", rng.choice(names) + rng.choice(names) + str(rng.randint(1, 30)), f"{rng.choice(wards)}{rng.randint(1, 9)}-{rng.randint(1, 20)}-{rng.randint(1, 9)}", 35.73 + rng.choice([0, 0, 0.00004, 0.0002]), 139.78)
    existing = [row(i, "e") for i in range(150)]
    existing += [(f"s{i}", "同じ名前", f"新宿区四谷{i}-1", 35.73, 139.78) for i in range(9)]  # one name, one locality, other blocks
    existing.append(("e900", "名無し", None, 35.73, 139.78))
    targets = [row(i, "t") for i in range(30)] + existing[:8] + [("t900", "名無し", None, 35.73, 139.78), ("t901", "", "新宿区四谷三99", 35.73004, 139.78)]
    scored, inner = [], M._scored
    monkeypatch.setattr(M, "_scored", lambda pairs, th: scored.append(pairs.count()) or inner(pairs, th))
    t, e = spark.createDataFrame(targets, SCHEMA), spark.createDataFrame(existing, SCHEMA)
    got = {}
    for r in M.match_candidates(t, e, 3).orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["existing_id"])
    assert got == _brute_force(t, e, 3)
    assert scored[0] < len(targets) * len(existing) / 2
    # rows that come twice are no more candidates than once
    again = {}
    for r in M.match_candidates(t.filter("id like 't%'"), e.union(e.filter("id < 'e060'")), 3).orderBy("target_id", "rank").collect():
        again.setdefault(r["target_id"], []).append(r["existing_id"])
    assert again == {k: v for k, v in got.items() if k.startswith("t")}
