"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8, name: str = "meguri") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def allow_shift_jis(spark: SparkSession) -> None:
    """Spark 4 reads Shift_JIS only with its older list of charsets.  This is a
    setting of the whole session; the readers of such files call it."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def broadcast_as_measured(spark: SparkSession) -> None:
    """Leave broadcasts to adaptive execution, which has counted the rows it sends, and keep them small.

    Before a job Spark knows the sizes of files only, and a file of 9 MB may hold a
    million rows, which the driver then builds a table of. A shuffle of 10 MB still made tables of
    25 MB there, several for a job. This is a setting of the whole session.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(static) != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, "256k")
        spark.conf.set(static, "-1")


def stages_on_all_cores(spark: SparkSession) -> None:
    """Let adaptive execution keep a part for each core where rows are few bytes but much work.

    By its default of 1 MB a part, 650,000 rows that compress well became one task, and all
    that was worked out of them was done on one core. This is a setting of the whole session.
    """
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    if spark.conf.get(least, None) is None:
        spark.conf.set(least, "64k")


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, which goes
    when the process ends; on a cluster a machine-local folder would be lost with
    its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="meguri-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the
    rows survive the loss of an executor, and later passes read columns."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them again in the filter.

    Spark moves a filter below the projection it reads from by copying the
    expressions into it; a column it may not copy keeps the filter in place.
    """
    return df.withColumn("_here", F.spark_partition_id()).filter(condition & (F.col("_here") >= 0)).drop("_here")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over the cluster by a hash of all columns.

    A table of few columns compresses so well that a million rows are one file split, and
    all that is worked out of them would be one task. Two parts a core, a number that adaptive
    execution keeps: by their bytes alone it would put them together again. Spark would move
    later filters on worked-out columns below the dealing, back into that task; here they stay above.
    """
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return only_where(df.repartition(parts, *[F.col(f"`{c}`") for c in df.columns]), F.lit(True))
