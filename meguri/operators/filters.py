"""Filters, list page and eligibility."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.session import settled

PAGE_SIZE = 100
DEFAULT_MIN_UNITS = 6
SORTS = ["address_asc", "address_desc", "name_asc", "name_desc", "units_desc", "units_asc"]


@dataclass(frozen=True)
class BuildingFilter:
    """Search conditions of the building list, with the list's defaults."""

    prefecture: str | None = None
    city: str | None = None
    town: str | None = None
    keyword: str | None = None
    min_units: int = DEFAULT_MIN_UNITS
    include_unknown_units: bool = True
    property_types: tuple[str, ...] = tuple(vocab.PROPERTY_TYPES)
    statuses: tuple[str, ...] = (vocab.NOT_DISTRIBUTED,)
    sort: str = "address_asc"
    page: int = 1
    area_master: dict = field(default_factory=lambda: vocab.AREA_MASTER, compare=False)


def _first(value):
    return (value[0] if value else None) if isinstance(value, list) else value


def _many(value) -> list[str]:
    values = [] if value is None else value if isinstance(value, list) else [value]
    return [p.strip() for v in values for p in v.split(",") if p.strip()]


def _number(text, fallback):
    try:
        return float(text)
    except (TypeError, ValueError):
        return fallback


def parse_filter(params: dict) -> BuildingFilter:
    """query parameters -> conditions; unreadable values take the default."""
    text = {k: _first(v) for k, v in params.items()}
    types = tuple(t for t in _many(params.get("type")) if t in vocab.PROPERTY_TYPES)
    statuses = tuple(s for s in _many(params.get("status")) if s in vocab.STATUSES)
    units = _number(text.get("minUnits") or (0 if text.get("minUnits") == "" else None), -1.0)
    known = units == units and 0 <= units < float("inf")
    page = _number(text.get("page"), 1.0)
    return BuildingFilter(
        prefecture=text.get("prefecture") or None,
        city=text.get("city") or None,
        town=text.get("town") or None,
        keyword=(text.get("q") or "").strip() or None,
        min_units=int(units) if known else DEFAULT_MIN_UNITS,
        include_unknown_units=text.get("unknownUnits") != "0",
        property_types=types or tuple(vocab.PROPERTY_TYPES),
        statuses=statuses or (vocab.NOT_DISTRIBUTED,),
        sort=text.get("sort") if text.get("sort") in SORTS else "address_asc",
        page=max(1, int(page)) if page == page and page != float("inf") else 1,
    )


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def area_condition(f: BuildingFilter) -> Column:
    """the prefecture is not tested when the city alone names it, so rows
    whose prefecture is unknown stay in the list."""
    owners = [p for p, cities in f.area_master.items() if f.city in cities]
    conditions = []
    if f.prefecture and owners != [f.prefecture]:
        conditions.append(F.col("prefecture") == f.prefecture)
    if f.city:
        conditions.append(F.col("city") == f.city)
    if f.town:
        conditions.append(F.col("town") == f.town)
    return _all(conditions)


def keyword_condition(f: BuildingFilter) -> Column:
    """any of three columns contains the keyword, case-insensitively."""
    if not f.keyword:
        return F.lit(True)
    word = f.keyword.translate(str.maketrans("%,()", "    "))
    like = f"%{word}%"
    return (
        F.col("building_name").ilike(like)
        | F.col("address").ilike(like)
        | F.col("normalized_address").ilike(like)
    )


def units_condition(f: BuildingFilter) -> Column:
    """unit threshold; an unknown count is kept unless asked otherwise."""
    units = F.col("total_units")
    if f.min_units > 0:
        enough = units >= f.min_units
        return (enough | units.isNull()) if f.include_unknown_units else enough
    return F.lit(True) if f.include_unknown_units else units.isNotNull()


def type_condition(f: BuildingFilter) -> Column:
    """property type, not tested when all three are chosen."""
    if len(f.property_types) >= len(vocab.PROPERTY_TYPES):
        return F.lit(True)
    return F.col("property_type").isin(list(f.property_types))


def common_condition(f: BuildingFilter) -> Column:
    return _all([area_condition(f), keyword_condition(f), units_condition(f), type_condition(f)])


def filter_buildings(buildings: DataFrame, f: BuildingFilter) -> DataFrame:
    return buildings.filter(common_condition(f) & F.col("status").isin(list(f.statuses)))


def sort_order(sort: str) -> list[Column]:
    """O1: two keys per order, unknown units last either way; id makes pages stable."""
    up = {c: F.col(c).asc_nulls_last() for c in ("normalized_address", "building_name", "total_units")}
    down = {c: F.col(c).desc_nulls_last() for c in up}
    orders = {
        "address_asc": [up["normalized_address"], up["building_name"]],
        "address_desc": [down["normalized_address"], down["building_name"]],
        "name_asc": [up["building_name"], up["normalized_address"]],
        "name_desc": [down["building_name"], up["normalized_address"]],
        "units_desc": [down["total_units"], up["normalized_address"]],
        "units_asc": [up["total_units"], up["normalized_address"]],
    }
    return [*orders.get(sort, orders["address_asc"]), F.col("id").asc()]


def positions(buildings: DataFrame, sort: str) -> DataFrame:
    """O1: the position of every row in an order, from 1.

    The sort deals rows by range; a row's place among its task's rows and the
    sizes of the tasks before give the position, one row a task being summed up.
    """
    placed = settled(buildings.orderBy(*sort_order(sort)).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_ahead"))
    return placed.withColumn("_task", task).join(ahead, "_task").withColumn(
        "position", F.col("_ahead") + place + 1).drop("_task", "_at", "_ahead")


def list_page(buildings: DataFrame, f: BuildingFilter, page_size: int = PAGE_SIZE) -> DataFrame:
    """O2: one page of the list. A page near the front is a top-n, not a full sort."""
    matched = filter_buildings(buildings, f).orderBy(*sort_order(f.sort))
    skip = (f.page - 1) * page_size
    return (matched.offset(skip) if skip else matched).limit(page_size)


def page_totals(buildings: DataFrame, f: BuildingFilter, page_size: int = PAGE_SIZE) -> DataFrame:
    """O2: total rows, page and page count (at least 1) as one row."""
    total = filter_buildings(buildings, f).agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long")
    return total.select("total", F.lit(f.page).alias("page"), pages.alias("page_count"))


def page_count(total: int, page_size: int = PAGE_SIZE) -> int:
    return max(1, ceil(total / page_size))


def building_history(history: DataFrame, building_id) -> DataFrame:
    """O3: the distributions of one building, latest first."""
    return history.filter(F.col("building_id") == building_id).orderBy(
        F.col("distributed_date").desc(), F.col("id").desc()
    )


def preview_samples(results: DataFrame, limit: int = 30) -> DataFrame:
    """Problem rows first; an outcome outside the list sorts before all."""
    rank = F.array_position(F.array(*[F.lit(o) for o in vocab.PREVIEW_PRIORITY]), F.col("outcome"))
    return results.orderBy(rank, "row_no").limit(limit)


def served_recently(last_date: Column, as_of: date, days: int = 90) -> Column:
    """hidden from the list: served within the last ``days`` days."""
    return F.coalesce(last_date > F.lit(as_of - timedelta(days=days)), F.lit(False))


def due_again(last_date: Column, as_of: date, days: int = 180) -> Column:
    """offered again: last served more than ``days`` days ago."""
    return F.coalesce(last_date < F.lit(as_of - timedelta(days=days)), F.lit(False))


def select_lines(plan: DataFrame, chosen: DataFrame, verdicts: list[str]) -> DataFrame:
    """the chosen lines whose verdict may be applied."""
    return plan.filter(F.col("verdict").isin(verdicts)).join(
        chosen.select("line").distinct(), "line", "left_semi"
    )


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, "\\.$", "")


def url_path(url: Column) -> Column:
    """Path and query of a URL, '/' when there is none; the fragment is not sent."""
    tail = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))


def is_blocked_host(host: Column, blocked: list[str] | None = None) -> Column:
    """the host or a parent domain of it is on the block list.

    The suffixes of the host are looked up in the list, so a long list costs
    no more per row than a short one's constant.
    """
    names = vocab.BLOCKED_HOSTS if blocked is None else blocked
    labels = F.split(F.regexp_replace(F.lower(host), "\\.$", ""), "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.arrays_overlap(suffixes, F.array(*[F.lit(n.lower()) for n in names]))


def path_pattern(pattern: Column) -> Column:
    """Robots path pattern -> anchored regular expression (``*`` and a final ``$``)."""
    anchored = pattern.endswith("$")
    body = F.regexp_replace(pattern, "\\$$", "")
    quoted = F.regexp_replace(body, "([\\\\.\\[\\]{}()+?^$|])", "\\\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def robots_groups(texts: DataFrame) -> DataFrame:
    """Rule groups (host, group_no, user_agents, rules, crawl_delay_ms) of landed robots texts.

    ``texts`` has host and body, one text a host.  Successive user-agent lines open one
    group; lines before the first group, without a colon or of other fields say
    nothing.  A rule without a path is none; the last readable delay of a group counts.
    """
    edges = "^\\s+|\\s+$"
    raw = texts.select("host", F.posexplode(F.split("body", "\r?\n")).alias("at", "raw"))
    line = raw.withColumn("raw", F.regexp_replace("raw", "#.*$", "")).filter(F.instr("raw", ":") > 0)
    said = line.select(
        "host", "at", F.lower(F.regexp_replace(F.substring_index("raw", ":", 1), edges, "")).alias("field"),
        F.regexp_replace(F.expr("substr(raw, instr(raw, ':') + 1)"), edges, "").alias("value"),
    )
    in_host = Window.partitionBy("host").orderBy("at")
    agent = F.col("field") == "user-agent"
    opens = (agent & ~F.lag(agent, 1, False).over(in_host)).cast("int")
    numbered = said.withColumn("_opens", opens).withColumn("group_no", F.sum("_opens").over(in_host)).filter("group_no > 0")
    number = F.col("value").rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$")
    seconds = F.when(F.col("value") == "", 0.0).when(number, F.col("value").try_cast("double"))
    delay = F.when((F.col("field") == "crawl-delay") & (seconds >= 0), F.floor(seconds * 1000 + 0.5))
    rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    ordered = lambda when, *what: F.array_sort(F.collect_list(F.when(when, F.struct("at", *what))))
    return numbered.groupBy("host", "group_no").agg(
        F.transform(ordered(agent, F.lower("value").alias("agent")), lambda x: x["agent"]).alias("user_agents"),
        F.transform(ordered(rule, "field", "value"), lambda x: F.struct(x["field"].alias("type"), x["value"].alias("path"))).alias("rules"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("at"))).cast("long").alias("crawl_delay_ms"),
    )


def _agent_groups(groups: DataFrame, agent: str) -> DataFrame:
    """The group that binds ``agent`` on each host: longest agent token contained
    in it, else the first ``*`` group."""
    named = groups.select("host", "group_no", F.explode("user_agents").alias("token"))
    tokens = named.withColumn("token", F.lower("token"))
    fits = tokens.filter((F.col("token") == "*") | F.lit(agent.lower()).contains(F.col("token")))
    specific = (F.col("token") != "*").cast("int")
    rank = F.struct(specific, specific * F.length("token"), -F.col("group_no"))
    return fits.groupBy("host").agg(F.max_by("group_no", rank).alias("group_no"))


def robots_decision(urls: DataFrame, groups: DataFrame, agent: str) -> DataFrame:
    """F8: whether ``agent`` may read each url.

    ``urls`` has url; ``groups`` has host, group_no, user_agents, rules (array of
    type, path), crawl_delay_ms.  The longest matching path wins, allow wins a
    tie, and no matching rule means allowed.  A host's rules stay one array, so a
    url is one row however many rules its host has.
    """
    bound = groups.join(_agent_groups(groups, agent), ["host", "group_no"], "left_semi")
    rules = bound.groupBy(F.col("host").alias("_host")).agg(
        F.flatten(F.collect_list(F.transform("rules", lambda r: F.struct(r["type"].alias("type"), r["path"].alias("path"), path_pattern(r["path"]).alias("pattern"))))).alias("_rules"),
        F.max("crawl_delay_ms").alias("crawl_delay_ms"),
    )
    target = urls.select("url").distinct().withColumns(
        {"_host": url_host(F.col("url")), "_path": url_path(F.col("url"))}
    )
    hits = F.filter("_rules", lambda r: F.coalesce(F.regexp_like(F.col("_path"), r["pattern"]), F.lit(False)))
    ranked = F.transform(hits, lambda r: F.struct(
        F.length(r["path"]).alias("size"), (r["type"] == "allow").cast("int").alias("allows"), r["type"].alias("type"), r["path"].alias("path")))
    best = target.join(rules, "_host", "left").select("url", F.array_max(ranked).alias("rule"), "crawl_delay_ms")
    denied = F.coalesce(F.col("rule.type") == "disallow", F.lit(False))
    return best.select(
        "url", (~denied).alias("allowed"),
        F.when(denied, F.col("rule.path")).alias("denied_by"), "crawl_delay_ms",
    )
