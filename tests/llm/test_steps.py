"""What a step leaves on disk."""

import time

import pytest
from pyspark.sql import functions as F

from meguri.llm import common


def _shuffled(spark) -> int:
    """Bytes of shuffle files that the session's block managers hold."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles().iterator()
    total = 0
    while files.hasNext():
        f = files.next()
        total += f.length() if f.getName().startswith("shuffle_") else 0
    return total


@pytest.mark.parametrize("twice", [False, True])
def test_shuffles_of_a_step_go_with_its_end(spark, twice):
    rows = spark.range(200_000).groupBy(F.xxhash64(F.col("id") % 150_000).alias("k")).agg(F.count("*").alias("n"))
    rows = rows.join(rows.withColumnRenamed("n", "m"), "k") if twice else rows
    before = _shuffled(spark)
    read = common.step(rows, "freed")
    for _ in range(20):  # files go a moment later
        if _shuffled(spark) - before < 100_000:
            break
        time.sleep(0.5)
    assert _shuffled(spark) - before < 100_000
    assert read.count() == 150_000 and read.agg(F.sum("n")).first()[0] == 200_000
    assert rows.count() == 150_000  # worked out again where it is asked for again


def test_a_step_leaves_the_session_as_it_was(spark):
    common.step(spark.range(5).toDF("id"), "plain")
    assert spark.conf.get(common._FREED, "false") == "false"
    with pytest.raises(Exception):
        common.step(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), "failed")
    assert spark.conf.get(common._FREED, "false") == "false"
    assert common.step(spark.range(0), "none").count() == 0
