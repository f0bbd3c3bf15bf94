"""Views over the driver's tables, and the registry of queries with their SQL.

The driver's tables hold no buildings, so both the Spark queries and their
DuckDB counterparts derive them with the same formulas.  ``VIEWS`` are those
formulas, in SQL both engines read; everything after them is written twice,
once with the library and once in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.address import with_address
from meguri.functions.names import normalize_name
from meguri.operators.aggregates import refresh_buildings
from meguri.plans.ingest import Snapshot
from meguri.session import broadcast_as_measured, settled, spread, stages_on_all_cores

_DIGITS = "translate(n.n_name,'0123456789_','ABCDEFGHIJ')"

VIEWS = {
    "buildings": f"""
SELECT c.c_custkey AS building_id, c.c_name AS building_name,
 concat(substr(r.r_name,1,3),'県') AS prefecture,
 concat({_DIGITS},'区') AS city,
 c.c_mktsegment AS town,
 CAST(1 + c.c_custkey % 6 AS INT) AS chome,
 CAST(1 + c.c_custkey % 40 AS INT) AS block,
 CAST(1 + c.c_custkey % 9 AS INT) AS house,
 concat({_DIGITS},'区',c.c_mktsegment,
   CAST(1 + c.c_custkey % 6 AS STRING),'-',CAST(1 + c.c_custkey % 40 AS STRING),
   '-',CAST(1 + c.c_custkey % 9 AS STRING)) AS address,
 CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE CAST(c.c_custkey % 30 AS INT) END AS total_units,
 CASE c.c_custkey % 3 WHEN 0 THEN 'rental' WHEN 1 THEN 'condominium' ELSE 'unknown' END AS property_type,
 CAST(35.70 AS DOUBLE) + CAST((c.c_custkey * 37) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS latitude,
 CAST(139.75 AS DOUBLE) + CAST((c.c_custkey * 91) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude,
 CASE c.c_custkey % 4 WHEN 0 THEN concat('osm:way/',CAST(c.c_custkey AS STRING))
   WHEN 1 THEN concat('csv:list#',CAST(c.c_custkey AS STRING))
   WHEN 2 THEN NULL ELSE concat('mock-arakawa:',CAST(c.c_custkey AS STRING)) END AS source_ref
FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
""",
    "past_list": """
SELECT building_id AS row_no, building_name,
 concat(prefecture,' ',city,town,
   translate(CAST(chome AS STRING),'0123456789','０１２３４５６７８９'),'丁目',
   CAST(block AS STRING),'番',CAST(house AS STRING),'号') AS address,
 CAST('2026-01-01' AS DATE) AS distributed_date
FROM buildings
""",
    # All orders, on every second hundred of buildings, so that the others wait.
    "history": """
SELECT o_orderkey AS history_id, o_custkey - 100 * (CAST(floor(o_custkey / 100) AS BIGINT) % 2) AS building_id,
 CAST(o_orderdate AS DATE) AS distributed_date
FROM {orders}
""",
    "points": """
SELECT p_partkey AS point_id,
 CAST(35.70 AS DOUBLE) + CAST((p_partkey * 53) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS latitude,
 CAST(139.75 AS DOUBLE) + CAST((p_partkey * 29) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude,
 concat(p_brand,'丁目') AS town, CAST(p_size AS STRING) AS block
FROM {part}
""",
    # A judged or waiting pair for every building, with its predecessor.
    "pairs": """
SELECT CAST(building_id AS STRING) AS id, CAST(building_id AS STRING) AS new_building_id,
 CAST(building_id - 1 AS STRING) AS possible_existing_building_id,
 CAST(CAST(building_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS DECIMAL(5,4)) AS address_similarity_score,
 CASE building_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' ELSE 'pending' END AS status,
 CASE WHEN building_id % 4 < 2 THEN CAST('2026-02-01' AS DATE) ELSE NULL END AS resolved_on
FROM buildings WHERE building_id > 0
""",
    # Names in two scripts, built from two common words and a number.
    "names": """
SELECT building_id, CAST(building_id % 4 AS INT) AS w1, CAST(floor(building_id / 4) % 4 AS INT) AS w2,
 CASE WHEN building_id % 2 = 0 THEN concat(
   CASE building_id % 4 WHEN 0 THEN 'グランド' WHEN 1 THEN 'ロイヤル' WHEN 2 THEN 'サン' ELSE 'グリーン' END,
   CASE floor(building_id / 4) % 4 WHEN 0 THEN 'メゾン' WHEN 1 THEN 'コート' WHEN 2 THEN 'ハイツ' ELSE 'パーク' END,
   translate(CAST(building_id % 50 AS STRING),'0123456789','０１２３４５６７８９'))
 ELSE concat(
   CASE building_id % 4 WHEN 0 THEN 'GRAND' WHEN 1 THEN 'Royal' WHEN 2 THEN 'SUN' ELSE 'Green' END,' ',
   CASE floor(building_id / 4) % 4 WHEN 0 THEN 'MAISON' WHEN 1 THEN 'Court' WHEN 2 THEN 'Heights' ELSE 'PARK' END,
   ' ',CAST(building_id % 50 AS STRING)) END AS name
FROM buildings
""",
}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SMALL = ("region", "nation")


class Tables:
    """The driver's tables and the derived views, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        broadcast_as_measured(spark)
        stages_on_all_cores(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str, **views: DataFrame) -> DataFrame:
        text = VIEWS[name]
        # A join that shuffled by nation would put the dealt rows into a few tasks again.
        used = {t: F.broadcast(self.table(t)) if t in _SMALL else spread(self.table(t)) for t in _TABLES if "{" + t + "}" in text}
        for view in views:
            text = text.replace(f"FROM {view} ", f"FROM {{{view}}} ").replace(f"FROM {view}\n", f"FROM {{{view}}}\n")
        return self.spark.sql(text, **used, **views)

    @cached_property
    def buildings(self) -> DataFrame:
        return self._view("buildings")

    @cached_property
    def past_list(self) -> DataFrame:
        return self._view("past_list", buildings=self.buildings)

    @cached_property
    def history(self) -> DataFrame:
        return self._view("history")

    @cached_property
    def points(self) -> DataFrame:
        return self._view("points")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._view("pairs", buildings=self.buildings)

    @cached_property
    def names(self) -> DataFrame:
        return self._view("names", buildings=self.buildings)

    # -- stored form ---------------------------------------------------------
    @cached_property
    def stored_history(self) -> DataFrame:
        return self.history.select(
            F.col("history_id").cast("string").alias("id"), F.col("building_id").cast("string").alias("building_id"),
            "distributed_date", F.lit(None).cast("string").alias("distributed_by"), F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.pairs.select(
            "id", "new_building_id", "possible_existing_building_id", "address_similarity_score",
            F.lit(0).cast("decimal(5,4)").alias("name_similarity_score"), F.lit(None).cast("double").alias("distance_meters"),
            F.array().cast("array<string>").alias("reason"), "status", F.col("resolved_on").cast("timestamp").alias("resolved_at"),
        )

    @cached_property
    def unserved_master(self) -> DataFrame:
        """The stored buildings before any history is applied."""
        return with_address(self.buildings, "address", "addr").select(
            F.col("building_id").cast("string").alias("id"), "building_name", "address",
            normalize_name(F.col("building_name")).alias("normalized_building_name"),
            F.col("addr.normalized").alias("normalized_address"), "prefecture", "city", "town", "total_units",
            "property_type", F.lit(None).cast("string").alias("building_type"), "latitude", "longitude",
            F.lit(vocab.NOT_DISTRIBUTED).alias("status"), F.lit(None).cast("date").alias("last_distributed_date"),
            F.lit(0).cast("long").alias("distribution_count"),
            F.when(F.col("source_ref").isNull(), "import").otherwise("data_source").alias("source"), "source_ref",
            F.lit(None).cast("string").alias("name_source"),
        )

    @cached_property
    def master(self) -> DataFrame:
        """The stored buildings with count, date and status from the history."""
        return refresh_buildings(self.unserved_master, self.stored_history, self.candidates)

    @cached_property
    def snapshot(self) -> Snapshot:
        """The stored tables as a job finds them: written, not views."""
        return Snapshot(
            settled(self.master, "master"), settled(self.stored_history, "history"), settled(self.candidates, "pairs")
        )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over :class:`Tables`, with its SQL where there is one."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


# -- SQL building blocks ------------------------------------------------------
def sql_normal_address(a: str) -> str:
    """DuckDB expression: the normal form of the address spellings used here."""
    x = f"translate({a},'０１２３４５６７８９　','0123456789 ')"
    x = f"regexp_replace(trim({x}),'^(北海道|東京都|京都府|大阪府|[^\\s]{{2,3}}県)','')"
    x = f"regexp_replace({x},'([0-9]+)\\s*(丁目|番地|番|号室|号|条)','\\1-','g')"
    x = f"lower(regexp_replace({x},'[\\s,._#:/]','','g'))"
    return f"regexp_replace(regexp_replace({x},'-+','-','g'),'^-|-$','','g')"


def sql_normal_name(n: str) -> str:
    """DuckDB expression: the surface form of the names used here."""
    hira = "".join(chr(c) for c in range(0x3041, 0x3097))
    kata = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
    return f"lower(regexp_replace(translate({n},'０１２３４５６７８９{hira}','0123456789{kata}'),'[\\s#.・-]','','g'))"


def sql_metres(la: str, oa: str, lb: str, ob: str, radius: float = 6371008.8) -> str:
    h = (
        f"pow(sin((radians({lb})-radians({la}))/2),2)+cos(radians({la}))*cos(radians({lb}))"
        f"*pow(sin((radians({ob})-radians({oa}))/2),2)"
    )
    return f"(2*{radius}*asin(sqrt({h})))"


def sql_jaro_winkler(x: str, y: str) -> str:
    """DuckDB expression: Jaro-Winkler, prefix of up to 4, weight 0.1.

    Its own functions halve an odd number of transpositions down and leave out
    the prefix of low scores.  Matches are gathered here as 1000 i + j.
    """
    reach = f"greatest(0, greatest(length({x}),length({y})) // 2 - 1)"
    free = f"list_filter(range(greatest(1, i[1] - {reach}), least(length({y}), i[1] + {reach}) + 1), lambda j: substr({y},j,1) = substr({x},i[1],1) AND NOT list_contains(list_transform(hits, lambda h: h % 1000), j))"
    steps = f"list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, length({x}) + 1), lambda i: [i]))"
    hits = f"list_reduce({steps}, lambda hits, i: CASE WHEN len({free}) = 0 THEN hits ELSE list_append(hits, i[1] * 1000 + ({free})[1]) END)"
    there = f"list_sort(list_transform({hits}, lambda h: h % 1000))"
    swapped = f"len(list_filter(list_zip(list_transform({hits}, lambda h: h // 1000), {there}), lambda p: substr({x},p[1],1) <> substr({y},p[2],1)))"
    m = f"len({hits})"
    jaro = f"(CASE WHEN {m} = 0 THEN CAST(0 AS DOUBLE) ELSE ({m} / length({x}) + {m} / length({y}) + ({m} - {swapped} / 2) / {m}) / 3 END)"
    lead = " ".join(f"WHEN least(length({x}),length({y})) < {n} OR left({x},{n}) <> left({y},{n}) THEN {n - 1}" for n in (1, 2, 3, 4))
    return f"({jaro} + (CASE {lead} ELSE 4 END) * CAST(0.1 AS DOUBLE) * (1 - {jaro}))"


def sql_name_score(x: str, y: str) -> str:
    """DuckDB expression: score of two different canonical names whose skeletons differ."""
    edit = f"(greatest(length({x}),length({y})) - levenshtein({x},{y})) / greatest(length({x}),length({y}))"
    return f"least(CAST(0.98 AS DOUBLE), greatest({edit}, {sql_jaro_winkler(x, y)} * CAST(0.95 AS DOUBLE)))"


_MASTER_SQL = f"""
SELECT CAST(b.building_id AS VARCHAR) AS id, b.building_name, b.address,
 {sql_normal_name('b.building_name')} AS normalized_building_name,
 {sql_normal_address('b.address')} AS normalized_address,
 b.prefecture, b.city, b.town, b.total_units, b.property_type, CAST(NULL AS VARCHAR) AS building_type,
 b.latitude, b.longitude,
 CASE WHEN coalesce(h.cnt,0) > 0 THEN 'CONFIRMED_DISTRIBUTED'
  WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.new_building_id = CAST(b.building_id AS VARCHAR) AND p.status = 'pending')
  THEN 'POSSIBLE_DUPLICATE' ELSE 'NOT_DISTRIBUTED' END AS status,
 h.last_date AS last_distributed_date, coalesce(h.cnt,0) AS distribution_count,
 CASE WHEN b.source_ref IS NULL THEN 'import' ELSE 'data_source' END AS source, b.source_ref
FROM buildings b LEFT JOIN (SELECT building_id, count(*) AS cnt, max(distributed_date) AS last_date
  FROM history GROUP BY building_id) h ON b.building_id = h.building_id
"""

# DuckDB's tables carry the plain names.
_SQL_VIEWS = {
    **{k: v.format(**{t: t for t in _TABLES}) for k, v in VIEWS.items()},
    "master": _MASTER_SQL,
}
_NEEDS = {"past_list": ["buildings"], "pairs": ["buildings"], "names": ["buildings"], "master": ["buildings", "history", "pairs"]}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names."""
    import re

    wanted: list[str] = []

    def want(view: str) -> None:
        for needed in _NEEDS.get(view, []):
            want(needed)
        if view not in wanted:
            wanted.append(view)

    for view in _SQL_VIEWS:
        if re.search(rf"\b{view}\b", sql):
            want(view)
    if not wanted:
        return sql.strip()
    head = ", ".join(f"{v} AS ({_SQL_VIEWS[v].strip()})" for v in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
