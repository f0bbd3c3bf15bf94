"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab


def _zero_filled(counts: DataFrame, key: str, values: list[str], count: str = "count") -> DataFrame:
    frame = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    return frame.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def history_rollup(history: DataFrame) -> DataFrame:
    """Distribution count and last date per building; partial sums before the shuffle."""
    return history.groupBy("building_id").agg(
        F.count("*").alias("distribution_count"), F.max("distributed_date").alias("last_distributed_date")
    )


def derived_status(count: Column, has_pending: Column) -> Column:
    return (
        F.when(count > 0, vocab.CONFIRMED).when(has_pending, vocab.POSSIBLE).otherwise(vocab.NOT_DISTRIBUTED)
    )


def refresh_buildings(buildings: DataFrame, history: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """A1: count, last date and status of every building from the history."""
    rolled = history_rollup(history).withColumnRenamed("building_id", "id")
    out = buildings.drop("distribution_count", "last_distributed_date").join(rolled, "id", "left")
    count = F.coalesce("distribution_count", F.lit(0)).cast("long")
    if candidates is None:
        pending = F.lit(False)
    else:
        waiting = pending_counts(candidates).withColumnRenamed("building_id", "id")
        out = out.join(waiting, "id", "left")
        pending = F.coalesce("pending_duplicate_count", F.lit(0)) > 0
    out = out.withColumns({"distribution_count": count, "status": derived_status(count, pending)})
    return out.select(*_with_columns(buildings.columns, "distribution_count", "last_distributed_date", "status"))


def _with_columns(columns: list[str], *extra: str) -> list[str]:
    return [*columns, *[c for c in extra if c not in columns]]


def refresh_changed(buildings: DataFrame, history: DataFrame, candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """A1 for the buildings named in ``changed`` (id) only; the others keep their row."""
    touched = buildings.join(changed.select("id").distinct(), "id", "left_semi")
    mine = history.join(changed.select(F.col("id").alias("building_id")).distinct(), "building_id", "left_semi")
    rest = buildings.join(changed.select("id").distinct(), "id", "left_anti")
    return rest.unionByName(refresh_buildings(touched, mine, candidates).select(*rest.columns))


def pending_counts(candidates: DataFrame) -> DataFrame:
    return (
        candidates.filter(F.col("status") == "pending")
        .groupBy(F.col("new_building_id").alias("building_id"))
        .agg(F.count("*").alias("pending_duplicate_count"))
    )


def with_pending_counts(buildings: DataFrame, candidates: DataFrame) -> DataFrame:
    """A2: the list view: every building with its count of waiting candidates."""
    counts = pending_counts(candidates).withColumnRenamed("building_id", "id")
    return buildings.join(counts, "id", "left").withColumn(
        "pending_duplicate_count", F.coalesce("pending_duplicate_count", F.lit(0)).cast("long")
    )


def status_counts(buildings: DataFrame, condition: Column) -> DataFrame:
    """A3: buildings per status under the list's conditions, zero-filled."""
    counts = buildings.filter(condition).groupBy("status").agg(F.count("*").alias("count"))
    return _zero_filled(counts, "status", vocab.STATUSES)


def area_options(buildings: DataFrame, prefecture: str | None, city: str | None,
                 master: dict | None = None, supported: DataFrame | None = None) -> DataFrame:
    """Distinct prefectures, cities and towns to choose from, as (level, name).

    Stored areas, the area master and the areas a source supports are merged.
    """
    master = vocab.AREA_MASTER if master is None else master
    spark = buildings.sparkSession

    def level(name: str, condition: Column) -> DataFrame:
        rows = buildings.filter(condition).select(F.lit(name).alias("level"), F.col(name).alias("name"))
        return rows.filter(F.coalesce("name", F.lit("")) != "")

    parts = [level("prefecture", F.lit(True))]
    fixed = [("prefecture", p) for p in master]
    if prefecture:
        parts.append(level("city", F.col("prefecture") == prefecture))
        fixed += [("city", c) for c in master.get(prefecture, [])]
    if city:
        in_city = F.col("city") == city
        parts.append(level("town", in_city & (F.col("prefecture") == prefecture) if prefecture else in_city))
    if supported is not None:
        same_pref = F.col("prefecture") == F.lit(prefecture)
        parts.append(supported.select(F.lit("prefecture").alias("level"), F.col("prefecture").alias("name")))
        parts.append(supported.filter(same_pref).select(F.lit("city").alias("level"), F.col("city").alias("name")))
        here = supported.filter(same_pref & (F.col("city") == F.lit(city)))
        parts.append(here.select(F.lit("town").alias("level"), F.explode("towns").alias("name")))
    if fixed:
        rows = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("name")) for a, b in fixed]))
        parts.append(spark.range(1).select(rows.alias("r")).select("r.level", "r.name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("level", "name")


def towns_of_city(buildings: DataFrame, prefecture: str, city: str) -> DataFrame:
    """A4: towns of one city in the stored lists."""
    return (
        buildings.filter((F.col("prefecture") == prefecture) & (F.col("city") == city))
        .filter(F.coalesce("town", F.lit("")) != "")
        .select("town").distinct().orderBy("town")
    )


def synced_count(buildings: DataFrame, prefecture: str | None, city: str | None) -> DataFrame:
    """A5: rows of the area that came from a data source; 0 unless both are given."""
    here = (F.col("city") == city) & (F.col("source") == "data_source") if prefecture and city else F.lit(False)
    return buildings.filter(here).agg(F.count("*").alias("count"))


def area_summary(buildings: DataFrame) -> DataFrame:
    """Rows per prefecture and city, most first."""
    known = (F.coalesce("prefecture", F.lit("")) != "") & (F.coalesce("city", F.lit("")) != "")
    return (
        buildings.filter(known).groupBy("prefecture", "city").agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "city", "prefecture")
    )


def conversion_statistics(converted: DataFrame) -> DataFrame:
    """One row of counts over converted map elements (columns of F7)."""
    ok = F.col("accepted")
    reasons = ["not_multi_dwelling", "mixed_use", "dormitory", "name_excluded", "no_address", "no_coordinates"]
    return converted.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("accepted"),
        *[F.count_if(~ok & (F.col("reason") == r)).alias(f"rejected_{r}") for r in reasons],
        F.count_if(ok & (F.col("building_name") != vocab.UNKNOWN_NAME)).alias("with_name"),
        F.count_if(ok & (F.coalesce("address", F.lit("")) != "")).alias("with_address"),
        F.count_if(ok & F.col("latitude").isNotNull()).alias("with_coordinates"),
        F.count_if(ok & F.col("total_units").isNotNull()).alias("with_total_units"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    """Rows per ingest outcome, zero-filled."""
    counts = results.groupBy("outcome").agg(F.count("*").alias("count"))
    return _zero_filled(counts, "outcome", vocab.INGEST_OUTCOMES)


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: rows excluded as of unknown use, and near misses."""
    return results.agg(
        F.count_if((F.col("outcome") == "excluded_use") & F.col("use_unknown")).alias("excluded_as_unknown_use"),
        F.count("near_miss").alias("near_misses"),
    )


def research_plan_counts(plan: DataFrame) -> DataFrame:
    """One row of counts by verdict of a research plan."""
    verdict = F.col("verdict")
    return plan.agg(
        F.count("*").alias("total"),
        F.count_if(verdict == "更新可能").alias("updatable"),
        F.count_if(verdict == "新規登録").alias("creatable"),
        F.count_if(verdict.isin("建物名競合", "住所競合", "要確認")).alias("needs_review"),
        F.count_if(verdict == "照合不可").alias("unmatched"),
        F.count_if(verdict == "変更なし").alias("no_change"),
        F.lit(0).cast("long").alias("error"),
    )


def name_plan_counts(plan: DataFrame) -> DataFrame:
    """Counts of a name-list plan by decision and reason."""
    return plan.groupBy("decision", "reason").agg(F.count("*").alias("count"))


MATCH_KINDS = [
    "id", "address_one", "address_many", "block_prefix_one", "block_prefix_many",
    "block_no_prefix", "block_absent", "address_unreadable",
]


def match_kind_counts(plan: DataFrame) -> DataFrame:
    """A10: how deep the research rows matched."""
    counts = plan.filter(F.col("match_kind").isNotNull()).groupBy("match_kind").agg(F.count("*").alias("count"))
    return _zero_filled(counts, "match_kind", MATCH_KINDS)


def provenance_by_status(buildings: DataFrame) -> DataFrame:
    """Rows by origin (prefix of the source id) and status."""
    ref = F.col("source_ref")
    origin = (
        F.when(ref.startswith("osm:"), "OSM")
        .when(ref.startswith("mock-arakawa:"), "開発用モック（残存＝異常）")
        .when(ref.startswith("mock:"), "開発用モック新形式（残存＝異常）")
        .when(ref.startswith("csv:"), "CSV")
        .when(ref.isNull(), "手入力・過去配布リスト")
        .otherwise("その他")
    )
    return buildings.groupBy(origin.alias("origin"), "status").agg(F.count("*").alias("count"))


def coalesced_counts(buildings: DataFrame, column: str, missing: str) -> DataFrame:
    """Rows per value, with one label for NULL."""
    key = F.coalesce(F.col(column), F.lit(missing)).alias(column)
    return buildings.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), column)


def bounding_box(points: DataFrame) -> DataFrame:
    """South, west, north, east and the number of points; NULL box when empty."""
    return points.agg(
        F.min("latitude").alias("south"), F.min("longitude").alias("west"),
        F.max("latitude").alias("north"), F.max("longitude").alias("east"), F.count("*").alias("points"),
    )


def grouped_messages(failures: DataFrame) -> DataFrame:
    """Failures grouped by message, with counts."""
    counts = failures.groupBy("message").agg(F.count("*").alias("count"))
    return counts.withColumn("text", F.concat("message", F.lit("（"), F.col("count").cast("string"), F.lit(" 件）")))


def import_batch(results: DataFrame, file_name: str, kind: str = "distributed", mapping: dict | None = None,
                 batch: str | None = None) -> DataFrame:
    """The audit row of one import; ``batch`` tells imports of one file name apart."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    pairs = [F.lit(x) for kv in (mapping or {}).items() for x in kv]
    mapped = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    return results.agg(
        F.count("*").alias("total_rows"),
        n("inserted").alias("inserted_rows"),
        n("merged").alias("merged_rows"),
        n("possible_duplicate", "already_distributed").alias("duplicate_rows"),
        n("skipped").alias("skipped_rows"),
    ).select(
        F.sha2(F.lit(f"{kind}/{batch or file_name}"), 256).alias("id"),
        F.lit(file_name).alias("file_name"), F.lit(kind).alias("kind"), "*", mapped.alias("column_mapping"),
    )


def completion_outcome(completed: DataFrame) -> DataFrame:
    """Addresses completed, failed, and the rate in percent (one decimal)."""
    done, total = F.count("completed_address"), F.count("*")
    return completed.agg(
        total.alias("requested"), done.alias("completed"), (total - done).alias("failed"),
        F.round(F.when(total > 0, done / total * 100), 1).alias("rate_percent"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.max(F.when(F.col("table") == name, F.col("n"))).alias(name) for name in tables])
