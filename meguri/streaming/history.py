"""The history rollup as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meguri.functions import vocab
from meguri.operators.aggregates import derived_status
from meguri.session import settled
from meguri.sources import store

KEY = ["building_id", "distributed_date"]


def write_epoch(changed: DataFrame, epoch: int, path: str) -> None:
    """Store the rows an epoch changed; an epoch run again replaces itself."""
    changed.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def start_rollup(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep count and last date per building from a stream of history changes.

    ``changes``: building_id, distributed_date, and op (``insert`` or
    ``delete``; absent means insert).  An update is a delete of the old row and
    an insert of the new one.  A maximum cannot be taken back, so the state is the
    number of rows per building and date, which deletes lower like any other
    change; update mode hands on only what an epoch touched.  ``path`` and
    ``checkpoint`` lie in shared storage.
    """
    writer = _counted(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: write_epoch(batch, epoch, path)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The last stored number of each building and date, with its epoch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    return rows.groupBy(*KEY).agg(F.max_by("n", "epoch").alias("n"), F.max("epoch").alias("epoch"))


def current_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Count and last date of every building that has history."""
    rows = _latest(spark, path).filter("n > 0")
    return rows.groupBy("building_id").agg(
        F.sum("n").alias("distribution_count"), F.max("distributed_date").alias("last_distributed_date"))


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Store the state as one epoch, the last there is, under ``new_path``; the
    stream goes on there with the same checkpoint, and ``path`` can go."""
    rows = _latest(spark, path)
    last = rows.agg(F.max("epoch").alias("e")).first()["e"]
    write_epoch(rows.filter("n <> 0").drop("epoch"), last, new_path)


def _counted(changes: DataFrame) -> DataFrame:
    sign = F.when(F.col("op") == "delete", -1).otherwise(1) if "op" in changes.columns else F.lit(1)
    return changes.groupBy(*KEY).agg(F.sum(sign).alias("n"))


def merge_epoch(changed: DataFrame, epoch: int, counts: str, master: str, parts: int = store.PARTS) -> None:
    """Bring the master up to date with an epoch: ``changed`` has the number of rows of
    each building and date that it touched.

    Reads and writes only the parts these buildings lie in. The numbers are whole ones, not
    differences, and versions are numbered by epoch, so an epoch run again gives the same.
    """
    spark = changed.sparkSession
    rows = settled(changed.filter(F.col("building_id").isNotNull()), "epoch")
    store.merge(rows, counts, epoch + 1, "building_id", KEY, parts)
    touched = rows.select("building_id").distinct()
    mine = store.read_where(spark, counts, "building_id", touched, parts)
    if mine is None:
        return
    there = F.col("n") > 0
    rolled = mine.groupBy("building_id").agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("_count"), F.max(F.when(there, F.col("distributed_date"))).alias("_last"))
    stored = store.read_where(spark, master, "id", touched.select(F.col("building_id").alias("id")), parts)
    if stored is None:
        return
    found = stored.join(rolled, stored["id"] == rolled["building_id"]).drop("building_id", "part")
    new = found.withColumns({
        "distribution_count": F.col("_count").cast("long"), "last_distributed_date": F.col("_last"),
        "status": derived_status(F.col("_count"), F.col("status") == vocab.POSSIBLE)}).drop("_count", "_last")
    store.merge(settled(new, "buildings"), master, epoch + 1, "id", ["id"], parts)


def start_master(changes: DataFrame, counts: str, master: str, checkpoint: str, available_now: bool = True, parts: int = store.PARTS) -> StreamingQuery:
    """X1 into the master: a stream of history changes keeps count, last date and status
    of the stored buildings.

    ``changes`` as for ``start_rollup``. ``master`` is a store of buildings by ``id``
    (``store.write(buildings, master, 0, "id")``); ``counts`` one that the stream makes.
    Buildings that the master lacks wait in ``counts``; null ids and dates without a building are left out. A
    building whose last row goes falls back to waiting (if it was) or not distributed. Without changes nothing is written.
    """
    writer = _counted(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: merge_epoch(batch, epoch, counts, master, parts))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
