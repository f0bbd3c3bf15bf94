"""First-wins dedup, duplicate reporting, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meguri.functions import vocab


def union_datasets(*datasets: DataFrame) -> DataFrame:
    """All stored lists as one, absent columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row per key in input order.

    ``row_number() = 1`` lets Spark keep one row per key before the shuffle, so
    a key held by a third of the rows sends one row per task, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, with their rank (pruned before the shuffle)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_line(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Add ``first_line``, the first line that carries the same key.

    Blank keys are exempt (NULL) and stay out of the join, where they would all
    meet in one task.  The minimum is aggregated before the join, so the join is
    many-to-one whatever the key's share.
    """
    blank = F.coalesce(key, F.lit("")) == ""
    firsts = df.filter(~blank).groupBy(key).agg(F.min(line).alias("first_line"))
    joined = df.filter(~blank).join(firsts, key, "left")
    exempt = df.filter(blank).withColumn("first_line", F.lit(None).cast(firsts.schema["first_line"].dataType))
    return joined.unionByName(exempt)


def reject_samples(rejects: DataFrame, n: int = 20, order: str = "row_no") -> DataFrame:
    """The first rejects in input order."""
    return rejects.orderBy(order).limit(n)


def unique_key_violations(buildings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows that repeat (normalized address, normalized name) of an earlier row.

    Rows without a normalized address are exempt.
    """
    order = order or ["id"]
    keys = ["normalized_address", "normalized_building_name"]
    keyed = buildings.filter(F.coalesce("normalized_address", F.lit("")) != "")
    firsts = keyed.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        keyed.join(firsts, keys).filter(F.struct(*order) > F.col("_first"))
        .withColumn("first_id", F.col("_first")[order[-1]]).drop("_first")
    )


def expand_coverage(coverage: DataFrame, master: dict | DataFrame | None = None) -> DataFrame:
    """(prefecture, city?) declarations -> one row per city; a declaration
    without a city covers every city of its prefecture in the area master, a
    small dict or a table (prefecture, city)."""
    if isinstance(master, DataFrame):
        wide = coverage.filter("city is null").select("prefecture").distinct().join(master.select("prefecture", "city"), "prefecture")
        return coverage.filter("city is not null").select("prefecture", "city").union(wide.select("prefecture", "city")).distinct()
    master = vocab.AREA_MASTER if master is None else master
    pairs = [F.lit(x) for p, cs in master.items() for x in (p, F.array(*[F.lit(c) for c in cs]))]
    cities = F.try_element_at(F.create_map(*pairs), F.col("prefecture"))
    listed = F.when(F.col("city").isNull(), cities).otherwise(F.array(F.col("city")))
    return coverage.select("prefecture", F.explode(listed).alias("city")).distinct()


def merge_areas(*areas: DataFrame) -> DataFrame:
    """Areas of several sources: distinct (prefecture, city), towns merged."""
    merged = union_datasets(*areas).select("prefecture", "city", F.explode_outer("towns").alias("town"))
    return merged.groupBy("prefecture", "city").agg(F.array_sort(F.collect_set("town")).alias("towns"))


def order_columns(df: DataFrame, id_column: str = "id") -> list[Column]:
    """The order in which 'the first' stored row is meant: (created_at, id); rows
    without a time come after those with one."""
    created = [F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp"))] if "created_at" in df.columns else []
    return [*created, F.col(id_column)]
