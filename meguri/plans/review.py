"""Reviewed duplicate decisions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.operators import aggregates
from meguri.operators.dedup import first_wins
from meguri.operators.joins import pending_ids
from meguri.plans.ingest import PAIR_KEYS, Snapshot


def apply_decisions(before: Snapshot, decisions: DataFrame, as_of: date) -> Snapshot:
    """Decisions (id of the pair, decision ``same`` or ``different``), in bulk.

    ``same`` gives the new building a history row dated from the matched
    building, else ``as_of``.  ``different`` puts it back on the list when no
    pair of it waits and it was never served.  Unknown pair ids are ignored.
    """
    valid = decisions.filter(F.col("decision").isin("same", "different"))
    once = first_wins(valid.select("id", "decision"), ["id"], ["decision"])
    judged = before.candidates.join(once, "id", "left")
    hit = F.col("decision").isNotNull()
    now = F.lit(datetime(as_of.year, as_of.month, as_of.day))
    candidates = judged.withColumns({
        "status": F.coalesce("decision", "status"),
        "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
    }).select(*before.candidates.columns)

    matched = before.buildings.select(
        F.col("id").alias(PAIR_KEYS[1]), F.col("last_distributed_date").alias("_on"), F.col("building_name").alias("_name")
    )
    same = judged.filter(F.col("decision") == "same").join(matched, PAIR_KEYS[1], "left")
    note = F.concat(F.lit("重複候補確認で「同じ建物」と判断（"), F.coalesce("_name", F.lit("既存物件")), F.lit("）"))
    events = same.select(
        F.sha2(F.concat(F.lit("pair|"), F.col("id")), 256).alias("id"), F.col(PAIR_KEYS[0]).alias("building_id"),
        F.coalesce("_on", F.lit(as_of)).alias("distributed_date"), F.lit(None).cast("string").alias("distributed_by"), note.alias("notes"),
    )
    history = before.history.unionByName(events, allowMissingColumns=True).select(*before.history.columns)
    buildings = aggregates.refresh_changed(before.buildings, history, candidates, events.select(F.col("building_id").alias("id")))

    apart = judged.filter(F.col("decision") == "different").select(F.col(PAIR_KEYS[0]).alias("id")).distinct()
    free = apart.join(pending_ids(candidates), "id", "left_anti").withColumn("_free", F.lit(True))
    back = F.col("_free") & (F.col("distribution_count") == 0)
    buildings = buildings.join(free, "id", "left").withColumn(
        "status", F.when(back, vocab.NOT_DISTRIBUTED).otherwise(F.col("status"))
    ).select(*before.buildings.columns)
    return Snapshot(buildings, history, candidates)
