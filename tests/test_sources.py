import pytest
from pyspark.sql import functions as F

from meguri.operators import filters as L
from meguri.operators.quality import missing_columns, over_limit
from meguri.sources import csv_files as C
from meguri.sources import pages as P
from meguri.streaming import history as X

CSV = """建物名,住所,総戸数,種別,緯度,経度
青葉ハウス,東京都荒川区南千住2-8-1,18,賃貸,35.7311,139.7988
もみじ荘,荒川区町屋6-2-4,,分譲,,

欅の館,東京都荒川区南千住5-9-2,,,,
,,,,,
"番地なし, ""離れ""
二行目",,5,,,
"""


@pytest.mark.parametrize("encoding, kind", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("shift_jis", "shift_jis")])
def test_building_list(spark, tmp_path, encoding, kind):
    path = tmp_path / "list.csv"
    path.write_bytes(CSV.replace("\n", "\r\n").encode(encoding))
    assert C.file_encodings(spark, str(path)).first()["encoding"] == kind
    done = C.building_list(C.read_csv(spark, str(path)), "csv", "荒川")
    rows = {r["building_name"]: r for r in done.records.collect()}
    first = rows["青葉ハウス"]
    assert (first["prefecture"], first["city"], first["town"], first["total_units"], first["property_type"]) == ("東京都", "荒川区", "南千住", 18, "rental")
    assert first["source_ref"] == "csv:荒川#1" and rows["もみじ荘"]["prefecture"] == "東京都"
    assert rows["欅の館"]["total_units"] is None and len(rows) == 3
    assert [(r["row"], r["reason"]) for r in done.rejects.collect()] == [(5, "住所が空です")]


def test_folder_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("建物名,住所\n甲荘,荒川区町屋1-1\n".encode())
    (tmp_path / "b.csv").write_bytes("住所,建物名,総戸数\n荒川区町屋1-2,乙荘,5\n".encode())
    (tmp_path / "c.csv").write_bytes("\ufeff建物名,住所\r\n\r\n丙荘,荒川区町屋1-3\r\n".encode())
    (tmp_path / "d.csv").write_bytes("住所,建物名\n荒川区町屋1-4,丁荘\n".encode("shift_jis"))
    got = sorted((r["建物名"], r["住所"], r["総戸数"], r["line"]) for r in C.read_csv(spark, str(tmp_path)).collect())
    assert got == sorted([("甲荘", "荒川区町屋1-1", None, 1), ("乙荘", "荒川区町屋1-2", "5", 1), ("丙荘", "荒川区町屋1-3", None, 1), ("丁荘", "荒川区町屋1-4", None, 1)])


def test_deeply_nested_page(spark):
    pages = spark.createDataFrame([(1, "u", "<div>" * 50_000 + "<p class='x'>deep" + "<b>" * 3000)], "page_id long, url string, html string")
    assert [r["t"] for r in P.extract_items(pages, "p.x", {"t": {"selector": ""}}).collect()] == ["deep"]


def test_header_mapping():
    assert C.map_headers(["物件名", "住所", "備考"])["building_name"] == "物件名"
    assert C.map_headers(["用途", "総戸数"])["building_use"] == "用途"
    guess = C.guess_mapping(["配布先の建物名", "所在地", "配布日", "担当"])
    assert guess == {"building_name": "配布先の建物名", "address": "所在地", "distributed_date": "配布日", "distributed_by": "担当"}
    assert missing_columns(["﻿Building_ID ", "address"], ["building_id", "status"]) == ["status"]


def test_limits_and_paths(spark):
    assert over_limit(spark.range(6), 5) and not over_limit(spark.range(5), 5) and not over_limit(spark.range(9), None)


# The markup is the fixed form that the listing patterns read; the rows are made up.
LISTING = """
<div><a href="https://archive.example/archive/b-1001/" target="_blank">
  <h2><span class="font-bold">銀杏の家</span> <span>マンション</span></h2>
  <p><span><img src="map_gray.png"></span>
    荒川区西尾久3丁目7-5
  </p></a></div>
<div><a href="https://archive.example/archive/b-1002/" target="_blank"><h2><span class="font-bold">桔梗ビル</span></h2><p>荒川区西尾久3丁目8-1</p></a></div>
<div><a href="https://archive.example/archive/b-1003/" target="_blank"><h2><span class="font-bold">番地のない家</span></h2><p>荒川区西尾久</p></a></div>"""


def test_listing_pages(spark):
    pages = spark.createDataFrame([(1, "u", LISTING), (2, "u", "<html>該当なし</html>"), (3, "u", LISTING)], "page_id long, url string, html string")
    found = P.distinct_candidates(P.listing_candidates(pages)).orderBy("pos").collect()
    assert [(r["page_id"], r["name"], r["address"]) for r in found] == [(1, "銀杏の家", "荒川区西尾久3丁目7-5"), (1, "桔梗ビル", "荒川区西尾久3丁目8-1")]


def test_configured_extraction(spark):
    html = """<ul id="list"><li class="item x"><a href="/b/1"> 甲  ハイツ </a><span class="addr">東京都荒川区町屋1-1</span><span>全24戸</span>
    <li class="item"><a href="b/2">乙荘</a><p class="addr"></p></li></ul><a class="next" href="?page=2">次</a><div class="towns"><a>東日暮里（120件）</a><a>町屋(3)</a><a>町屋</a></div>"""
    pages = spark.createDataFrame([(1, "https://ex.example/list/", html)], "page_id long, url string, html string")
    fields = {"building_name": {"selector": "a"}, "address": {"selector": ".addr"}, "detail_url": {"selector": "a", "attribute": "href"},
              "total_units": {"selector": "span, p", "pattern": "("}, "property_type": {"selector": "b"}}
    items = P.extract_items(pages, "#list li.item", fields, "a.next").orderBy("pos").collect()
    assert [(r["building_name"], r["address"], r["detail_url"]) for r in items] == [("甲 ハイツ", "東京都荒川区町屋1-1", "/b/1"), ("乙荘", None, "b/2")]
    assert items[0]["next_page_url"] == "https://ex.example/list/?page=2" and items[0]["item_count"] == 2 and items[0]["total_units"] is None
    fields["total_units"] = {"selector": "", "pattern": "全(\\d+)戸"}
    record = P.listing_records(P.extract_items(pages, "#list li.item", fields), "site").collect()
    assert len(record) == 1 and record[0]["source_ref"] == "site:https://ex.example/b/1" and record[0]["total_units"] == 24 and record[0]["city"] == "荒川区"
    assert [r["town"] for r in P.town_index(pages, ".towns a").collect()] == ["東日暮里", "町屋"]


def test_robots_and_hosts(spark):
    rule = lambda kind, path: (kind, path)
    groups = spark.createDataFrame([
        ("ex.example", 1, ["*"], [rule("disallow", "/private"), rule("allow", "/private/open"), rule("disallow", "/*.php$")], 2000),
        ("ex.example", 2, ["reader"], [rule("disallow", "/only-reader")], None), ("free.example", 1, ["other"], [rule("disallow", "/")], None),
    ], "host string, group_no int, user_agents array<string>, rules array<struct<type:string,path:string>>, crawl_delay_ms long")
    paths = ["/", "/private/x", "/private/open/x", "/a.php", "/a.php/b", "/a.php/b.php", "/only-reader"]
    urls = spark.createDataFrame([(f"https://ex.example{p}",) for p in paths] + [("https://free.example/x",)], "url string")
    any_agent = {r["url"]: r["allowed"] for r in L.robots_decision(urls, groups, "someone/1.0").collect()}
    assert [any_agent[f"https://ex.example{p}"] for p in paths] == [True, False, True, False, True, False, True] and any_agent["https://free.example/x"]
    named = {r["url"]: r["allowed"] for r in L.robots_decision(urls, groups, "Reader/2.0").collect()}
    assert [named[f"https://ex.example{p}"] for p in paths] == [True, True, True, True, True, True, False]
    hosts = spark.createDataFrame([("www.SUUMO.jp.",), ("suumo.jp.example",), ("x.yahoo.co.jp",)], "h string")
    assert [r["b"] for r in hosts.select(L.is_blocked_host(F.col("h")).alias("b")).collect()] == [True, False, True]


def test_filter_parameters():
    f = L.parse_filter({"minUnits": "x", "page": "0", "type": "rental,bad", "status": ["CONFIRMED_DISTRIBUTED"], "q": "  ", "sort": "units_desc"})
    assert (f.min_units, f.page, f.property_types, f.statuses, f.keyword, f.sort) == (6, 1, ("rental",), ("CONFIRMED_DISTRIBUTED",), None, "units_desc")
    assert L.parse_filter({}).statuses == ("NOT_DISTRIBUTED",) and L.parse_filter({"minUnits": "0"}).min_units == 0


def test_area_and_units(spark):
    rows = [("a", None, "荒川区", "町屋", None, "A", "x", "x", "rental", "NOT_DISTRIBUTED"), ("b", "東京都", "荒川区", "町屋", 5, "B", "x", "x", "rental", "NOT_DISTRIBUTED"),
            ("c", "他県", "荒川区", "町屋", 9, "C_1", "x", "x", "rental", "NOT_DISTRIBUTED")]
    df = spark.createDataFrame(rows, "id string, prefecture string, city string, town string, total_units int, building_name string, address string, normalized_address string, property_type string, status string")
    ids = lambda **kw: sorted(r["id"] for r in L.filter_buildings(df, L.BuildingFilter(**kw)).collect())
    assert ids(prefecture="東京都", city="荒川区") == ["a", "c"]  # the city names the prefecture
    assert ids(prefecture="他県") == ["c"] and ids(include_unknown_units=False) == ["c"] and ids(min_units=0) == ["a", "b", "c"]
    assert ids(keyword="c_1") == ["c"] and ids(keyword="%") == []


def test_streamed_rollup_in_epochs_and_after_a_delete(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    schema = "id long, building_id string, distributed_date date, op string"

    def land(rows, op="insert"):
        rows = [(*r, op) for r in rows]
        spark.createDataFrame(rows, "id long, building_id string, d string, op string").selectExpr("id", "building_id", "cast(d as date) distributed_date", "op").coalesce(1).write.mode("append").parquet(source)
        X.start_rollup(spark.readStream.schema(schema).parquet(source), out, check).awaitTermination()
        return {r["building_id"]: (r["distribution_count"], str(r["last_distributed_date"])) for r in X.current_rollup(spark, out).collect()}

    assert land([(1, "a", "2026-01-01"), (2, "a", "2026-02-01"), (3, "b", "2026-01-05")]) == {"a": (2, "2026-02-01"), "b": (1, "2026-01-05")}
    assert land([(4, "b", "2026-03-01")]) == {"a": (2, "2026-02-01"), "b": (2, "2026-03-01")}
    assert land([(2, "a", "2026-02-01"), (3, "b", "2026-01-05"), (4, "b", "2026-03-01")], "delete") == {"a": (1, "2026-01-01")}
    assert land([(5, "c", "2026-04-01")]) == {"a": (1, "2026-01-01"), "c": (1, "2026-04-01")}  # a is not in this epoch
    moved = str(tmp_path / "moved")
    X.compact(spark, out, moved)
    out = moved
    assert land([(6, "a", "2026-05-01"), (7, "a", "2026-05-01")]) == {"a": (3, "2026-05-01"), "c": (1, "2026-04-01")}
