"""Archive, delete, repair and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.operators.joins import release_stranded, requarantine
from meguri.operators.quality import cascade
from meguri.plans.ingest import PAIR_KEYS, Snapshot


def archive_rows(df: DataFrame, table: str, version: str) -> DataFrame:
    """Rows as JSON text, with the version of the job that took them away."""
    return df.select(
        F.lit(version).alias("version"), F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_id"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("row_data"),
    )


def restore_rows(archive: DataFrame, table: str, version: str, into: DataFrame) -> DataFrame:
    """Archived rows of a table that ``into`` does not have (by id)."""
    mine = archive.filter((F.col("table_name") == table) & (F.col("version") == version))
    rows = mine.select(F.from_json("row_data", into.schema).alias("r")).select("r.*")
    return rows.join(into.select("id"), "id", "left_anti").select(*into.columns)


def development_rows(prefix: str = "mock-arakawa:") -> Column:
    return F.coalesce(F.col("source_ref").startswith(prefix), F.lit(False))


def remove_rows(before: Snapshot, archive: DataFrame, version: str, chosen: Column | None = None) -> tuple[Snapshot, DataFrame]:
    """Archive and delete the chosen buildings with their history and pairs.

    Buildings with distributions are protected.  A version already in the
    archive means the job ran, and nothing changes.
    """
    if not archive.filter(F.col("version") == version).isEmpty():
        return before, archive
    pick = development_rows() if chosen is None else chosen
    gone = before.buildings.filter(pick & (F.col("distribution_count") == 0))
    ids = gone.select("id")
    candidates, lost_pairs = cascade(before.candidates, ids, *PAIR_KEYS)
    history, lost_events = cascade(before.history, ids, "building_id")
    taken = archive_rows(gone, "buildings", version)
    taken = taken.unionByName(archive_rows(lost_events, "distribution_history", version))
    taken = taken.unionByName(archive_rows(lost_pairs, "duplicate_candidates", version))
    kept = before.buildings.join(ids, "id", "left_anti").select(*before.buildings.columns)
    buildings = release_stranded(kept, candidates).select(*before.buildings.columns)
    return Snapshot(buildings, history, candidates), archive.unionByName(taken)


def restore_version(before: Snapshot, archive: DataFrame, version: str) -> tuple[Snapshot, DataFrame]:
    """Put archived rows back: buildings first, then what belongs to them.

    A building whose id, or whose (address, name) key, is in use again stays
    out, and its children with it.
    """
    back = restore_rows(archive, "buildings", version, before.buildings)
    keys = ["normalized_address", "normalized_building_name"]
    used = before.buildings.filter(F.coalesce("normalized_address", F.lit("")) != "").select(*keys)
    back = back.join(used, keys, "left_anti").select(*before.buildings.columns)
    buildings = before.buildings.unionByName(back)
    ids = buildings.select("id")

    def children(table: str, rows: DataFrame, *refs: str) -> DataFrame:
        restored = restore_rows(archive, table, version, rows)
        for ref in refs:
            restored = restored.join(ids.select(F.col("id").alias(ref)), ref, "left_semi")
        return rows.unionByName(restored.select(*rows.columns))

    history = children("distribution_history", before.history, "building_id")
    candidates = children("duplicate_candidates", before.candidates, *PAIR_KEYS)
    buildings = requarantine(buildings, candidates).select(*before.buildings.columns)
    return Snapshot(buildings, history, candidates), archive.filter(F.col("version") != version)
