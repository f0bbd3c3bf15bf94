"""Tables stored in parts, of which a job reads and writes only those it touches.

A part is a range of hashes of one column (a city, a building). Each job writes
the parts it changes whole, as a new version beside the old one; the newest version of a
part counts. So a version that is written again, after a failure, replaces itself, and
parts without changes keep their files.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 32  # of a small table; a large one is given more, the same wherever it is read and written
_PLACE = re.compile(r"/version=(\d+)/part=(\d+)/")


def part_of(column: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The newest version of each part, of those under ``below``."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException:  # nothing stored so far
        return {}
    newest: dict[int, int] = {}
    for version, part in (map(int, m.groups()) for m in map(_PLACE.search, files) if m):
        if below is None or version < below:
            newest[part] = max(version, newest.get(part, -1))
    return newest


def read(spark: SparkSession, path: str, parts: list[int] | None = None, below: int | None = None) -> DataFrame | None:
    """The stored rows, or those of some parts; only their files are opened. None if there are none."""
    places = [f"{path}/version={v}/part={p}" for p, v in sorted(versions(spark, path, below).items()) if parts is None or p in parts]
    return spark.read.parquet(*places) if places else None


def read_where(spark: SparkSession, path: str, by: str, values: DataFrame, parts: int = PARTS) -> DataFrame | None:
    """The stored rows whose ``by``, the column that makes the parts, is among ``values`` (one column)."""
    wanted = values.select(values[values.columns[0]].alias(by)).distinct()
    places = [r[0] for r in wanted.select(part_of(F.col(by), parts)).distinct().collect()]  # at most ``parts``
    found = read(spark, path, places)
    return None if found is None else found.join(wanted, by, "left_semi")


def write(rows: DataFrame, path: str, version: int, by: str, parts: int = PARTS) -> None:
    """Store whole parts as a version; rows of a value of ``by`` lie together in their files."""
    placed = rows.withColumn("part", part_of(F.col(by), parts))
    placed.repartition(F.col("part")).sortWithinPartitions("part", by).write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={version}")


def merge(changed: DataFrame, path: str, version: int, by: str, key: list[str], parts: int = PARTS) -> None:
    """Put ``changed`` in place of the stored rows of the same ``key``, and store the parts it lies in.

    ``changed`` has one row a key, is read twice and is best written before; a row whose ``by`` changes must come
    with a deletion of the old one elsewhere. No rows: nothing is stored.
    """
    spark = changed.sparkSession
    places = [r[0] for r in changed.select(part_of(F.col(by), parts)).distinct().collect()]  # at most ``parts``
    if not places:
        return
    old = read(spark, path, places, version)
    kept = changed if old is None else old.join(changed.select(*key), key, "left_anti").unionByName(changed, allowMissingColumns=True)
    write(kept, path, version, by, parts)
