"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_DATE, _TS = T.DateType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BUILDINGS = _struct(
    id=_S, building_name=_S, address=_S, normalized_building_name=_S, normalized_address=_S,
    address_extra=_S, prefecture=_S, city=_S, town=_S, total_units=_I, property_type=_S,
    building_use=_S, building_use_note=_S, building_type=_S, latitude=_D, longitude=_D, status=_S,
    last_distributed_date=_DATE, distribution_count=_L, source=_S, source_ref=_S,
    address_source=_S, address_precision=_S, name_source=_S, name_decided_at=_TS, created_at=_TS,
)
HISTORY = _struct(
    id=_S, building_id=_S, distributed_date=_DATE, distributed_by=_S, notes=_S, created_at=_TS,
)
CANDIDATES = _struct(
    id=_S, new_building_id=_S, possible_existing_building_id=_S,
    address_similarity_score=T.DecimalType(5, 4), name_similarity_score=T.DecimalType(5, 4),
    distance_meters=_D, reason=T.ArrayType(_S), status=_S, resolved_at=_TS, created_at=_TS,
)
INPUT_ROWS = _struct(
    row_no=_L, building_name=_S, address=_S, prefecture=_S, city=_S, town=_S, total_units=_I,
    property_type=_S, building_use_raw=_S, address_source=_S, address_precision=_S, latitude=_D,
    longitude=_D, source_ref=_S,
    distribution=_struct(distributed_date=_DATE, distributed_by=_S, notes=_S),
)
IMPORT_BATCHES = _struct(
    id=_S, file_name=_S, kind=_S, total_rows=_L, inserted_rows=_L, merged_rows=_L,
    duplicate_rows=_L, skipped_rows=_L, column_mapping=T.MapType(_S, _S), created_at=_TS,
)
NAME_LOOKUPS = _struct(
    block_key=_S, prefecture=_S, city=_S, source=_S,
    candidates=T.ArrayType(_struct(name=_S, address=_S, source=_S)), candidate_count=_L,
)
FIELD_UPDATES = _struct(
    id=_L, batch_id=_S, building_id=_S, field_name=_S, old_value=_S, new_value=_S, source=_S, note=_S,
)
ARCHIVE = _struct(version=_S, table_name=_S, row_id=_S, row_data=_S)
MAP_ELEMENTS = _struct(
    elements=T.ArrayType(
        _struct(
            type=_S, id=_L, lat=_D, lon=_D, center=_struct(lat=_D, lon=_D),
            tags=T.MapType(_S, _S),
        )
    )
)
API_PAYLOAD = _struct(
    id=_S, name=_S, address=_S, prefecture=_S, city=_S, town=_S, type=_S, units=_S, lat=_S, lng=_S,
)
