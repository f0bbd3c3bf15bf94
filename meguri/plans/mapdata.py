"""Map elements to source records, and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions.osm import convert_elements
from meguri.operators.joins import complete_addresses
from meguri.session import only_where, settled

POINTS_PER_TILE = 1500
MAX_SIDE = 4
OVERLAP_DEGREES = 0.0001


def grid_side(points: Column) -> Column:
    """Tiles per side for a number of points, 1 to 4."""
    tiles = F.ceil(points / POINTS_PER_TILE)
    side = F.ceil(F.sqrt(tiles.cast("double"))).cast("int")
    return F.greatest(F.lit(1), F.least(F.coalesce(side, F.lit(1)), F.lit(MAX_SIDE)))


def area_grids(points: DataFrame, by: str) -> DataFrame:
    """A13 per area, with the grid that splits it: one row per area."""
    box = points.groupBy(by).agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.count("*").alias("points"),
    ).withColumn("side", grid_side(F.col("points")))
    return box.withColumns({
        "lat_step": (F.col("north") - F.col("south")) / F.col("side"),
        "lon_step": (F.col("east") - F.col("west")) / F.col("side"),
    })


def _edges(low: str, step: str, i: Column) -> tuple[Column, Column]:
    """Bounds of strip ``i``, widened by the overlap where another strip adjoins."""
    start = F.col(low) + F.col(step) * i - F.when(i > 0, OVERLAP_DEGREES).otherwise(0.0)
    end = F.col(low) + F.col(step) * (i + 1) + F.when(i < F.col("side") - 1, OVERLAP_DEGREES).otherwise(0.0)
    return start, end


def tiles(points: DataFrame, by: str) -> DataFrame:
    """The tiles of each area: (area, tile, south, west, north, east)."""
    grids = area_grids(points, by)
    strips = F.sequence(F.lit(0), F.col("side") - 1)
    cells = grids.withColumn("row", F.explode(strips)).withColumn("col", F.explode(strips))
    south, north = _edges("south", "lat_step", F.col("row"))
    west, east = _edges("west", "lon_step", F.col("col"))
    return cells.select(
        by, (F.col("row") * F.col("side") + F.col("col")).alias("tile"), south.alias("south"), west.alias("west"),
        north.alias("north"), east.alias("east"),
    )


def assign_tiles(rows: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """Each located row with every tile of its area that holds it.

    The strip is computed, not searched: a row is tried in its own strip and
    the two beside it, for the overlap.
    """
    grids = area_grids(points, by)
    joined = rows.join(grids, by)

    def near(value: str, low: str, step: str) -> Column:
        own = F.when(F.col(step) > 0, F.floor((F.col(value) - F.col(low)) / F.col(step))).otherwise(0).cast("int")
        last = F.col("side") - 1
        clamp = lambda i: F.greatest(F.lit(0), F.least(i, last))
        return F.array_distinct(F.array(clamp(own - 1), clamp(own), clamp(own + 1)))

    tried = joined.withColumn("row", F.explode(near("latitude", "south", "lat_step")))
    tried = tried.withColumn("col", F.explode(near("longitude", "west", "lon_step")))
    south, north = _edges("south", "lat_step", F.col("row"))
    west, east = _edges("west", "lon_step", F.col("col"))
    # One tile is the area itself, whatever rounding does to its edge.
    single = F.col("side") == 1
    inside = single | (F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return tried.filter(inside).select(*rows.columns, (F.col("row") * F.col("side") + F.col("col")).alias("tile"))


def records_of_elements(elements: DataFrame, points: DataFrame, prefecture: str, city: str, town: str | None = None) -> DataFrame:
    """Accepted elements as source records, addresses completed from the
    nearest reference point; records still without an address are dropped."""
    accepted = settled(only_where(convert_elements(elements, prefecture, city), F.col("accepted")), "accepted")
    has = accepted.filter("address <> ''")
    open_rows = accepted.filter("address = '' and latitude is not null").withColumn("row_no", F.col("source_ref"))
    done = complete_addresses(open_rows, points, prefecture, city).filter("completed_address is not null").withColumns({
        "address": F.col("completed_address"), "prefecture": F.lit(prefecture), "city": F.lit(city), "town": F.col("point_town"),
        "address_source": F.col("completed_source"), "address_precision": F.col("completed_precision"),
    })
    out = has.unionByName(done.select(*has.columns)).drop("accepted", "reason", "detail")
    return out if town is None else out.filter(F.contains("address", F.lit(town)))
