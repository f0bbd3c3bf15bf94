"""Row and table checks (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import parse, vocab
from meguri.functions.address import address_parts, with_address
from meguri.functions.names import with_name
from meguri.functions.text import trim_space
from meguri.functions.use import EXCLUDED, with_use
from meguri.operators.dedup import first_line, unique_key_violations

COMPLETION_COLUMNS = ["building_id", "address", "building_name", "status", "source", "note"]
RESEARCH_REQUIRED = ["building_name", "address"]
RESEARCH_COLUMNS = [
    "building_id", "building_name", "address", "total_units", "property_type", "building_type", "source", "note",
]
IMPORT_ROW_LIMIT = 5_000  # optional batch limits (Q4); off unless asked for
LIST_ROW_LIMIT = 100_000


def missing_columns(columns: list[str], required: list[str]) -> list[str]:
    """Q2: required columns a file lacks; any means a whole-file error."""
    present = {c.replace("﻿", "").strip().lower() for c in columns}
    return [c for c in required if c not in present]


def file_errors(headers: DataFrame, required: list[str]) -> DataFrame:
    """Q2 for many files: file and missing (required columns that it lacks, in their order) of each
    file that lacks any. ``headers`` has file and columns (array); a null header lacks them all."""
    clean = F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.lower(trim_space(F.regexp_replace(c, "\ufeff", ""))))
    missing = F.filter(F.array(*map(F.lit, required)), lambda r: ~F.array_contains(clean, r))
    return headers.select("file", missing.alias("missing")).filter(F.size("missing") > 0)


def batches_over(rows: DataFrame, batch: str, limit: int | None) -> DataFrame:
    """Q4 for many batches: batch and n of those with more rows than the limit; none without a limit."""
    counted = rows.groupBy(batch).agg(F.count("*").alias("n"))
    return counted.filter(F.lit(False) if limit is None else F.col("n") > limit)


def over_limit(df: DataFrame, limit: int | None) -> bool:
    """Q4: true when a batch holds more rows than an optional limit."""
    return limit is not None and df.limit(limit + 1).count() > limit


def _trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    present = {c.replace("﻿", "").strip().lower(): c for c in df.columns}
    cell = lambda c: trim_space(F.coalesce(F.col(f"`{present[c]}`"), F.lit(""))) if c in present else F.lit("")
    return df.select("line", *[cell(c).alias(c) for c in columns])


def check_completion_rows(df: DataFrame) -> DataFrame:
    """Name-list rows with an ``error`` column (NULL when valid).

    ``df`` has ``line`` and the file's columns as text.
    """
    rows = _trimmed(df, COMPLETION_COLUMNS).withColumn("status", F.upper("status"))
    rows = first_line(rows, "building_id")
    allowed = " / ".join(vocab.COMPLETION_STATUSES)
    line = F.col("first_line").cast("string")
    error = (
        F.when(F.col("building_id") == "", "building_id が空です。")
        .when(
            F.col("first_line") < F.col("line"),
            F.concat(F.lit("building_id が "), line, F.lit(" 行目と重複しています（"), "building_id", F.lit("）。")),
        )
        .when(
            ~F.col("status").isin(vocab.COMPLETION_STATUSES),
            F.concat(
                F.lit("status が不正です（"), F.when(F.col("status") == "", "空").otherwise(F.col("status")),
                F.lit(f"）。許可値: {allowed}"),
            ),
        )
        .when(
            F.col("status").isin("CONFIRMED", "HIGH") & (F.col("building_name") == ""),
            F.concat(F.lit("status が "), "status", F.lit(" なのに building_name が空です。")),
        )
    )
    return rows.withColumn("error", error).drop("first_line")


def check_research_rows(df: DataFrame) -> DataFrame:
    """Research rows with an ``error`` for a repeated building id; blank ids are exempt."""
    rows = first_line(_trimmed(df, RESEARCH_COLUMNS), "building_id")
    repeat = F.col("first_line") < F.col("line")
    error = F.when(repeat, F.concat(
        F.lit("building_id が "), F.col("first_line").cast("string"), F.lit(" 行目と重複しています（"),
        "building_id", F.lit("）。"),
    ))
    return rows.withColumn("error", error).drop("first_line")


def _violation(df: DataFrame, table: str, rule: str, row_id: Column, condition: Column) -> DataFrame:
    return df.filter(F.coalesce(condition, F.lit(False))).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), row_id.cast("string").alias("row_id")
    )


def violations(buildings: DataFrame, history: DataFrame, candidates: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Q3: rows that break a table rule, as (table_name, rule, row_id)."""
    b, h, c = buildings, history, candidates
    pair = ["new_building_id", "possible_existing_building_id"]
    first_pair = c.groupBy(*pair).agg(F.min("id").alias("_first"))
    orphans = h.join(b.select(F.col("id").alias("building_id")), "building_id", "left_anti")
    parts = [
        _violation(b, "buildings", "units_not_negative", F.col("id"), F.col("total_units") < 0),
        _violation(b, "buildings", "known_property_type", F.col("id"), ~F.col("property_type").isin(vocab.PROPERTY_TYPES)),
        _violation(b, "buildings", "known_status", F.col("id"), ~F.col("status").isin(vocab.STATUSES)),
        _violation(unique_key_violations(b), "buildings", "unique_address_and_name", F.col("id"), F.lit(True)),
        _violation(orphans, "distribution_history", "building_exists", F.col("id"), F.lit(True)),
        _violation(c, "duplicate_candidates", "not_self", F.col("id"), F.col(pair[0]) == F.col(pair[1])),
        _violation(
            c.join(first_pair, pair), "duplicate_candidates", "unique_pair", F.col("id"), F.col("id") > F.col("_first")
        ),
    ]
    for side in pair:
        lost = c.join(b.select(F.col("id").alias(side)), side, "left_anti")
        parts.append(_violation(lost, "duplicate_candidates", "building_exists", F.col("id"), F.lit(True)))
    if updates is not None:
        parts.append(_violation(
            updates, "building_field_updates", "known_field", F.col("id"), ~F.col("field_name").isin(vocab.RESEARCH_FIELDS)
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade(children: DataFrame, removed: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Q3: split child rows into (kept, removed) when buildings in ``removed`` (id) go."""
    gone = removed.select("id").distinct()
    kept = children
    for key in keys:
        kept = kept.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    kept = kept.select(*children.columns)
    lost = children.join(kept.select("id"), "id", "left_anti")
    return kept, lost


def prepare_rows(rows: DataFrame, reject_development: bool = True) -> DataFrame:
    """Q5: add the comparison columns and the reason a row cannot be taken in.

    ``rows`` follow schemas.INPUT_ROWS (absent columns count as NULL).  A row
    needs a usable address, except that a past-distribution row may have only a
    name.  Adds normalized_address, address_extra, name_key, canonical, use,
    rejected (NULL, ``skipped`` or ``excluded_use``) and message.
    """
    defaults = {
        "prefecture": "string", "city": "string", "town": "string", "total_units": "int", "property_type": "string",
        "building_use_raw": "string", "address_source": "string", "address_precision": "string",
        "latitude": "double", "longitude": "double", "source_ref": "string",
        "distribution": "struct<distributed_date:date,distributed_by:string,notes:string>",
    }
    absent = {c: F.lit(None).cast(t) for c, t in defaults.items() if c not in rows.columns}
    out = rows.withColumns(absent) if absent else rows
    out = out.withColumn("address", trim_space(F.coalesce("address", F.lit(""))))
    out = with_name(with_address(out, "address", "addr"), "building_name", "name")
    out = with_use(out.withColumn("_parts", address_parts(F.col("address"))), "building_use_raw", "building_name", "use")
    unnamed = (F.col("building_name") == vocab.UNKNOWN_NAME) & (F.coalesce("source_ref", F.lit("")) != "")
    name = F.col("name.normalized")
    out = out.withColumns({
        "normalized_address": F.col("addr.normalized"),
        "address_extra": F.nullif(F.col("addr.extra"), F.lit("")),
        "name_key": F.when(unnamed, F.concat(name, F.lit("#"), "source_ref")).otherwise(name),
        "canonical": F.col("name.canonical"),
        **{c: F.coalesce(c, F.col(f"_parts.{c}")) for c in ("prefecture", "city", "town")},
        "is_past": F.col("distribution").isNotNull(),
    })
    usable = (F.col("address") != "") & (F.col("normalized_address") != "")
    by_name = F.col("is_past") & (name != "")
    dev = parse.is_development(F.col("source_ref")) & F.lit(reject_development)
    off_use = ~F.col("is_past") & (F.col("use.use") == EXCLUDED)
    rejected = F.when(~usable & ~by_name, "skipped").when(dev, "skipped").when(off_use, "excluded_use")
    message = (
        F.when(~usable & ~by_name, "住所が空、または住所として解釈できませんでした")
        .when(dev, "開発用データのため本番環境では登録しません（source_ref が mock で始まる行）")
        .when(off_use, F.col("use.reason"))
    )
    return out.withColumns({"rejected": rejected, "message": message}).drop("_parts")
