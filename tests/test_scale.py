"""What grows with the tables: how they are read, broadcasts, pairs that are gathered."""

from __future__ import annotations

from pyspark.sql import functions as F

from meguri.catalog.base import Tables
from meguri.operators import joins as J
from meguri.operators.dedup import first_line
from meguri.session import settled, spread


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_file_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    rows.coalesce(1).write.parquet(path)
    dealt = spread(spark.read.parquet(path))
    assert "RepartitionByExpression" in _optimized(dealt)
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_views_deal_their_tables_out(spark, tmp_path):
    for name in ("customer", "nation", "region", "orders", "part"):
        columns = {
            "customer": "id AS c_custkey, 'a' AS c_name, CAST(0 AS INT) AS c_nationkey, 'T' AS c_mktsegment",
            "nation": "CAST(0 AS INT) AS n_nationkey, 'NATION_0' AS n_name, CAST(0 AS INT) AS n_regionkey",
            "region": "CAST(0 AS INT) AS r_regionkey, 'ASIA' AS r_name",
            "orders": "id AS o_orderkey, id AS o_custkey, DATE '2026-01-01' AS o_orderdate",
            "part": "id AS p_partkey, 'B' AS p_brand, CAST(1 AS INT) AS p_size",
        }[name]
        spark.range(1 if name in ("nation", "region") else 20).selectExpr(*columns.split(", ")).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    for view in (t.buildings, t.history, t.points):
        assert "RepartitionByExpression" in _optimized(view)
        assert view.count() == 20
    plan = t.buildings._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_small_files_of_many_rows_are_not_broadcast_unmeasured(spark, tmp_path):
    """300,000 ids that compress to next to nothing, but are 10 MB and more as rows."""
    Tables(spark, str(tmp_path))
    text = F.concat(F.lit("x" * 60), (F.col("id") % 7).cast("string"))
    stored = settled(spark.range(300_000).select("id", text.alias("name")), "wide")
    joined = settled(spark.range(300_000), "keys").join(stored, "id", "left")
    assert joined.count() == 300_000
    plan = joined._jdf.queryExecution().executedPlan()
    joined.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" not in plan.toString()


def test_pairs_too_far_apart_are_not_gathered(spark):
    rows = spark.createDataFrame([(1, 35.7, 139.75), (2, 35.8, 139.75), (3, None, 139.0)], "row_no int, latitude double, longitude double")
    # About 190 m, 300 m east of the first row; 199 m north of it; one 250 m from the second.
    points = spark.createDataFrame(
        [(10, "a", "1", 35.7, 139.7521), (11, "a", "2", 35.7, 139.75332), (12, "a", "3", 35.70179, 139.75), (13, "a", "4", 35.80225, 139.75)],
        "point_id int, town string, block string, latitude double, longitude double")
    near = J.nearest_point(rows, points)
    assert sorted((r["row_no"], r["point_id"]) for r in near.collect()) == [(1, 10), (2, None), (3, None)]
    only_north = J.nearest_point(rows, points.filter("point_id > 10")).filter("row_no = 1").first()
    assert only_north["point_id"] == 12 and only_north["distance_m"] == 199
    plan = _optimized(near)
    assert plan.index("Aggregate [row_no") < plan.index("<= 200.0")


def test_cells_hold_all_within_the_distance():
    for distance in (50.0, 200.0, 1000.0):
        lat, lon = J._snap_cell(distance)
        assert lat * 111_195 > distance and lon * 111_195 * 0.1909 > distance  # cos 79 degrees


def test_filters_on_worked_out_columns_stay_above_the_dealing(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).coalesce(1).write.parquet(path)
    rows = spread(spark.read.parquet(path)).withColumn("worked", F.reverse(F.upper("name"))).filter("worked <> '7N'")
    plan = _optimized(rows)
    assert plan.index("reverse") < plan.index("RepartitionByExpression") and "reverse" not in plan.split("RepartitionByExpression")[1]
    assert rows.count() == 99


def test_tables_of_some_10_000_rows_are_not_built_on_the_driver(spark, tmp_path):
    Tables(spark, str(tmp_path))
    stored = settled(spark.range(40_000).select("id", F.lit("x" * 20).alias("name")), "narrow")
    names = stored.groupBy("id").agg(F.min("name").alias("name"))
    counted = settled(spark.range(300_000), "keys").join(names, "id", "left").agg(F.count("*"), F.count("name"))
    assert counted.collect() == [(300_000, 40_000)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_rows_of_few_bytes_stay_in_several_tasks(spark, tmp_path):
    Tables(spark, str(tmp_path))
    rows = spark.range(200_000).select((F.col("id") % 1000).alias("k"), F.lit("x" * 50).alias("name"))
    assert rows.repartition("k").rdd.getNumPartitions() > 1


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    rows = spark.createDataFrame([("a", 2), ("", 1), ("a", 3), (None, 4), ("b", 5), ("", 6)], "building_id string, line long")
    done = first_line(rows, "building_id")
    assert done.columns == ["building_id", "line", "first_line"]
    assert sorted((r["line"], r["building_id"], r["first_line"]) for r in done.collect()) == [
        (1, "", None), (2, "a", 2), (3, "a", 2), (4, None, None), (5, "b", 5), (6, "", None)]
    assert _optimized(done).startswith("Union")
