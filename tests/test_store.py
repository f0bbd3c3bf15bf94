"""Stored parts, the streamed master, and duplicate matching where many rows are alike."""

import datetime
import glob
import os

from pyspark.sql import functions as F

from meguri.operators.matching import match_candidates
from meguri.sources import store
from meguri.streaming import history as X


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_only_touched_parts(spark, tmp_path):
    path = str(tmp_path / "master")
    rows = spark.createDataFrame([(str(i), f"{chr(65 + i % 20)}区", i) for i in range(400)], "id string, city string, n int")
    assert store.read(spark, path) is None and store.versions(spark, path) == {}
    store.write(rows, path, 0, "city")
    before = files(path)
    changed = spark.createDataFrame([("3", "D区", -1), ("900", "D区", 7)], "id string, city string, n int")
    for _ in range(2):  # a version that is written again replaces itself
        store.merge(changed, path, 1, "city", ["id"])
    after = files(path)
    assert all(after[f] == t for f, t in before.items())  # nothing stored was written over
    new = [f for f in after if f not in before]
    assert len(new) == 1 and "version=1" in new[0]
    got = {r["id"]: r["n"] for r in store.read(spark, path).collect()}
    assert got == {str(i): i for i in range(400)} | {"3": -1, "900": 7}
    area = store.read_where(spark, path, "city", spark.createDataFrame([("D区",), ("nowhere",)], "c string"))
    assert sorted(r["n"] for r in area.collect()) == sorted([-1, 7, *(i for i in range(400) if i % 20 == 3 and i != 3)])
    assert len(area.inputFiles()) <= 2
    store.merge(changed.limit(0), path, 2, "city", ["id"])
    assert files(path) == after


def test_streamed_master(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    day = lambda k: datetime.date(2026, 1, k)
    buildings = [(str(i), "POSSIBLE_DUPLICATE" if i == 3 else "NOT_DISTRIBUTED", 0, None) for i in range(60)]
    store.write(spark.createDataFrame(buildings, "id string, status string, distribution_count long, last_distributed_date date"), at("master"), 0, "id")
    schema = "building_id string, distributed_date date, op string"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at("changes"))
        X.start_master(spark.readStream.schema(schema).parquet(at("changes")), at("counts"), at("master"), at("check")).awaitTermination()
        return {r["id"]: tuple(r)[1:] for r in store.read(spark, at("master")).select("id", "distribution_count", "last_distributed_date", "status").collect()}

    got = feed(("1", day(2), "insert"), ("1", day(5), "insert"), ("3", day(1), "insert"), ("elsewhere", day(1), "insert"), (None, day(1), "insert"), ("7", day(4), "delete"))
    assert got["1"] == (2, day(5), "CONFIRMED_DISTRIBUTED") and got["3"][0] == 1 and got["7"] == (0, None, "NOT_DISTRIBUTED") and len(got) == 60
    before = files(at("master"))
    got = feed(("1", day(5), "delete"), ("7", day(4), "insert"), ("7", day(9), "insert"))  # after a restart
    assert got["1"] == (1, day(2), "CONFIRMED_DISTRIBUTED") and got["7"] == (1, day(9), "CONFIRMED_DISTRIBUTED")
    assert sum(f not in before for f in files(at("master"))) <= 2  # what lies with the two buildings
    again = spark.createDataFrame([("1", day(5), 0), ("7", day(4), 0), ("7", day(9), 1)], "building_id string, distributed_date date, n long")
    X.merge_epoch(again, 1, at("counts"), at("master"))  # the epoch once more
    assert {r["id"]: r["distribution_count"] for r in store.read(spark, at("master")).collect()} == {k: v[0] for k, v in got.items()}


def test_many_rows_alike(spark):
    """4,000 served rows at one point and one address without a block number, of four names."""
    names = ["グランドメゾン1", "サンハイツ", "ロイヤルコート", "Green Park"]
    side = "id string, building_name string, address string, latitude double, longitude double"
    e = spark.createDataFrame([(f"e{i}", names[i % 4], "荒川区町屋", 35.7, 139.7) for i in range(4000)], side)
    t = spark.createDataFrame([(f"t{i}", "グランドメゾン2", "荒川区町屋", 35.7, 139.7) for i in range(3)] + [("e0", names[0], "荒川区町屋", 35.7, 139.7)], side)
    key = ["target_id", "rank", "existing_id"]
    few = match_candidates(t, e, 5).select(*key, "address_score", "name_score", "status").orderBy(*key).collect()
    everything = match_candidates(t, e, None).filter(F.col("rank") <= 5).select(*key, "address_score", "name_score", "status").orderBy(*key).collect()
    assert few == everything and few
