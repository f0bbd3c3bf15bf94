"""CSV lists: encodings, headers, building and distribution lists."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meguri.functions import parse, vocab
from meguri.functions.address import address_parts, prefecture_of_city
from meguri.functions.text import blank_to_null, trim_space
from meguri.operators.dedup import first_wins
from meguri.operators.quality import COMPLETION_COLUMNS, RESEARCH_REQUIRED, check_completion_rows, check_research_rows, missing_columns
from meguri.session import allow_shift_jis, settled

LINE = "line"
_BOM = "﻿"


def _file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, head) of each file: ``head`` is its first line as it
    stands, as hex.  Files are read by line, so they are split like any text."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.min_by(F.col("value").cast("binary"), F.struct("_block", "_at")).alias("_first"),
    ).select(
        "path", F.when(F.col("_utf8"), "utf-8").otherwise("shift_jis").alias("encoding"), F.hex("_first").alias("head"),
    )


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """S3: (path, encoding) of each file: valid UTF-8, with a BOM or without, says
    utf-8, else shift_jis.  (Spark's line reader takes a BOM away.)"""
    return _file_heads(spark, path).select("path", "encoding")


def _reader(spark: SparkSession, encoding: str):
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("header", True)
    if encoding == "shift_jis":
        allow_shift_jis(spark)
        return reader.option("encoding", "Shift_JIS")
    return reader.option("encoding", "UTF-8")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Text columns of CSV files with headers, plus ``line`` and ``file``.

    Quotes, doubled quotes, line breaks inside quotes, BOM and CRLF are read;
    rows whose cells are all blank are dropped.  Files of one folder may differ in
    encoding and in their columns or the order of them: files with the same first
    line are read together, by its columns, and the parts are put together by name, absent columns
    NULL.  A quoted cell may span lines, so a file is one task: large lists
    belong in many files.  ``line`` orders the rows as they stand; within one file
    it counts 1, 2, 3, ...  ``encoding`` says that all files have it.
    """
    heads = settled(_file_heads(spark, path), "heads")
    kind = F.when(F.col("encoding") == "shift_jis", "shift_jis").otherwise("utf-8") if encoding is None else F.lit(encoding.lower().replace("-", "_") if "shift" in encoding.lower() else "utf-8")
    layouts = heads.select(kind.alias("kind"), "head").distinct().collect()  # one row a layout
    parts = []
    for layout in sorted(layouts, key=lambda r: (r["kind"] != "utf-8", r["head"])):
        mine = heads.filter((kind == layout["kind"]) & (F.col("head") == layout["head"])).select(F.col("path").alias("file"))
        example = mine.agg(F.min("file")).first()[0]
        names = _reader(spark, layout["kind"]).csv(example).schema
        # by position under these names: a reader takes one list of columns for all it reads
        rows = _reader(spark, layout["kind"]).schema(names).option("enforceSchema", True).csv(path)
        parts.append(_numbered(rows, mine if len(layouts) > 1 else None))
    if not parts:
        return _numbered(_reader(spark, "utf-8").csv(path), None)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _numbered(df: DataFrame, files: DataFrame | None) -> DataFrame:
    """Cleaned rows with file and line; of ``files`` (file) only, if given."""
    cells = [F.coalesce(trim_space(F.col(f"`{c}`")), F.lit("")) for c in df.columns]
    clean = [F.col(f"`{c}`").alias(c.replace(_BOM, "").strip()) for c in df.columns]
    placed = df.select(*clean, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"),
                       F.concat(*cells).alias("_all"))
    if files is not None:
        placed = placed.join(files, "file", "left_semi")
    kept = placed.filter("_all <> ''").drop("_all")
    # Blank rows leave gaps; the rank within the file, read by one task, closes them.
    rank = F.row_number().over(Window.partitionBy("file").orderBy("_at"))
    return kept.withColumn(LINE, rank.cast("long")).drop("_at")


def map_headers(headers: list[str]) -> dict[str, str | None]:
    """Field -> header: an exact alias first, else one that contains an alias."""
    mapping: dict[str, str | None] = {}
    used: set[str] = set()
    for fieldname, aliases in vocab.LIST_HEADERS:
        free = [h for h in headers if h not in used]
        exact = next((h for h in free if h in aliases), None)
        loose = next((h for h in free if any(a.lower() in h.lower() for a in aliases)), None)
        mapping[fieldname] = exact or loose
        used |= {mapping[fieldname]} - {None}
    return mapping


def guess_mapping(headers: list[str]) -> dict[str, str]:
    """Field -> header by ordered hints: the first hint that some header contains."""
    mapping: dict[str, str] = {}
    for fieldname, hints in vocab.IMPORT_HINTS:
        free = [h for h in headers if h not in mapping.values()]
        hits = (h for hint in hints for h in free if hint.lower() in h.lower())
        found = next(hits, None)
        if found:
            mapping[fieldname] = found
    return mapping


@dataclass
class BuildingList:
    records: DataFrame
    rejects: DataFrame  # row (the header is row 1), reason
    columns: dict[str, str | None]


def building_list(rows: DataFrame, source_id: str, dataset: str, master: dict | None = None) -> BuildingList:
    """List rows -> source records; rows without an address are rejected.

    ``rows`` are text columns with ``line``.  Trimmed, blank is NULL, and what
    cannot be read stays NULL; area columns win over the parsed address.
    """
    headers = [c for c in rows.columns if c not in (LINE, "file")]
    mapping = map_headers(headers)

    def cell(name: str) -> Column:
        column = mapping[name]
        return blank_to_null(F.col(f"`{column}`")) if column else F.lit(None).cast("string")

    picked = rows.select(LINE, *[cell(n).alias(n) for n in mapping])
    reason = "住所が空です" if mapping["address"] else "住所の列が見つかりません"
    rejects = picked.filter("address is null").select((F.col(LINE) + 1).alias("row"), F.lit(reason).alias("reason"))
    staged = picked.filter("address is not null").withColumn("_p", address_parts(F.col("address")))
    city = F.coalesce("city", F.col("_p.city"))
    records = staged.select(
        F.col(LINE).alias("row_no"),
        F.concat(F.lit(f"{source_id}:{dataset}#"), F.col(LINE).cast("string")).alias("source_ref"),
        F.coalesce("building_name", F.lit(vocab.BLANK_NAME)).alias("building_name"), "address",
        F.coalesce("prefecture", F.col("_p.prefecture"), prefecture_of_city(city, master)).alias("prefecture"),
        city.alias("city"), F.coalesce("town", F.col("_p.town")).alias("town"),
        parse.property_type_of_source(F.col("property_type")).alias("property_type"),
        F.coalesce("building_use", "property_type").alias("building_use_raw"),
        parse.count_of_source(F.col("total_units")).alias("total_units"),
        parse.coordinate(F.col("latitude"), "latitude").alias("latitude"),
        parse.coordinate(F.col("longitude"), "longitude").alias("longitude"),
    )
    return BuildingList(records, rejects, mapping)


def distribution_list(rows: DataFrame, as_of: date, mapping: dict[str, str] | None = None) -> DataFrame:
    """Past-distribution rows -> input rows; an unreadable date becomes ``as_of``."""
    mapping = guess_mapping([c for c in rows.columns if c not in (LINE, "file")]) if mapping is None else mapping

    def cell(name: str) -> Column:
        column = mapping.get(name)
        return trim_space(F.coalesce(F.col(f"`{column}`"), F.lit(""))) if column else F.lit("")

    return rows.select(
        F.col(LINE).alias("row_no"),
        F.coalesce(F.nullif(cell("building_name"), F.lit("")), F.lit(vocab.BLANK_NAME)).alias("building_name"),
        cell("address").alias("address"),
        F.struct(
            F.coalesce(parse.date_of_import(cell("distributed_date")), F.lit(as_of)).alias("distributed_date"),
            F.nullif(cell("distributed_by"), F.lit("")).alias("distributed_by"),
            F.nullif(cell("notes"), F.lit("")).alias("notes"),
        ).alias("distribution"),
    )


def _require(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"必須の列がありません: {', '.join(missing)}")


def completion_list(rows: DataFrame) -> DataFrame:
    """Name-completion list, each row with its error or NULL."""
    _require(rows, COMPLETION_COLUMNS)
    return check_completion_rows(rows)


def research_list(rows: DataFrame) -> DataFrame:
    """Research list, each row with its error or NULL."""
    _require(rows, RESEARCH_REQUIRED)
    return check_research_rows(rows)


def records_in_area(records: DataFrame, prefecture: str, city: str, town: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Stored records of an area (an unknown prefecture passes), each
    (address, name) once, the first in order."""
    here = (F.coalesce("prefecture", F.lit(prefecture)) == prefecture) & (F.col("city") == city)
    if town:
        here = here & (F.col("town") == town)
    return first_wins(records.filter(here), ["address", "building_name"], order or ["row_no"])


EXPORT_COLUMNS = ["building_id", "prefecture", "city", "address", "latitude", "longitude", "current_building_name"]


def unnamed_buildings(buildings: DataFrame, prefecture: str | None = None, city: str | None = None) -> DataFrame:
    """Rows of the unknown-name export, by address."""
    unnamed = F.coalesce("building_name", F.lit("")).isin("", vocab.UNKNOWN_NAME)
    rows = buildings.filter(unnamed)
    for column, value in (("prefecture", prefecture), ("city", city)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.select(
        F.col("id").alias("building_id"), "prefecture", "city", "address", "latitude", "longitude",
        F.coalesce("building_name", F.lit("")).alias("current_building_name"),
    ).orderBy("address", "building_id")


def write_export(rows: DataFrame, path: str) -> None:
    """CSV for spreadsheets: BOM, CRLF, quotes only where needed.

    The BOM goes before the first header name, as Spark writes none.  The rows
    stay in their order over the part files, each with the header.
    """
    first, *rest = rows.columns
    named = rows.select(F.col(first).alias(_BOM + first), *rest)
    named.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)
