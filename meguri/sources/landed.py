"""Landed JSON and reference-point files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri import schemas
from meguri.functions import parse, vocab
from meguri.functions.text import blank_to_null, trim_space
from meguri.session import allow_shift_jis


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of landed responses, one row per element."""
    files = spark.read.schema(schemas.MAP_ELEMENTS).option("multiLine", True).json(path)
    return elements_of(files)


def elements_of(responses: DataFrame) -> DataFrame:
    return responses.select(F.explode("elements").alias("e")).select("e.*")


def read_block_points(spark: SparkSession, path: str, encoding: str = "Shift_JIS") -> DataFrame:
    """Reference points of a positional CSV (10 or more columns).

    Rows with unreadable coordinates or without city, town or block are
    dropped; write the result partitioned by city to read one city later.
    """
    if encoding.lower() == "shift_jis":
        allow_shift_jis(spark)
    raw = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').csv(path)
    return block_points(raw)


def block_points(raw: DataFrame) -> DataFrame:
    if len(raw.columns) < 10:
        raise ValueError("reference points need at least 10 columns")
    at = lambda i: F.col(f"`{raw.columns[i]}`")
    rows = raw.select(
        at(0).alias("prefecture"), at(1).alias("city"), at(2).alias("town"), at(4).alias("block"),
        parse.coordinate_unbounded(at(8)).alias("latitude"), parse.coordinate_unbounded(at(9)).alias("longitude"),
    )
    named = [F.coalesce(c, F.lit("")) != "" for c in ("city", "town", "block")]
    return rows.filter(named[0] & named[1] & named[2] & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_payload(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Landed interface payloads (JSON lines) -> source records."""
    return payload_records(spark.read.schema(schemas.API_PAYLOAD).json(path), source_id)


def payload_records(payload: DataFrame, source_id: str) -> DataFrame:
    rows = payload.withColumn("address", trim_space(F.coalesce("address", F.lit("")))).filter("address <> ''")
    return rows.select(
        F.when(F.col("id").isNotNull(), F.concat(F.lit(f"{source_id}:"), "id")).alias("source_ref"),
        F.coalesce(blank_to_null(F.col("name")), F.lit(vocab.BLANK_NAME)).alias("building_name"), "address",
        *[blank_to_null(F.col(c)).alias(c) for c in ("prefecture", "city", "town")],
        parse.property_type_of_source(F.col("type")).alias("property_type"),
        parse.count_of_source(F.col("units")).alias("total_units"),
        parse.coordinate(F.col("lat"), "latitude").alias("latitude"),
        parse.coordinate(F.col("lng"), "longitude").alias("longitude"),
    )
