"""Landed web pages: listings and indexes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meguri.functions import parse, vocab
from meguri.functions.address import _chome_number, _half_width, address_parts, block_key_text
from meguri.functions.text import SPACE_CLASS, trim_space
from meguri.operators.dedup import first_wins

# Markup of the known listing pages (fixed values).
LISTING_LINK = r'<a href="[^"]*/archive/b-[0-9]+/"'
LISTING_NAME = r'<span class="font-bold">([^<]+)</span>'
_NOT_SPACE = f'[^{SPACE_CLASS}<>"]'
LISTING_ADDRESS = f"({_NOT_SPACE}*?[市区町村]{_NOT_SPACE}*?[0-9]+丁目[0-9]+(?:-[0-9]+)?)"


def listing_candidates(pages: DataFrame, source: str = "homes_archive", link: str = LISTING_LINK,
                       name: str = LISTING_NAME, address: str = LISTING_ADDRESS) -> DataFrame:
    """(page_id, pos, name, address, source): the html cut at each building
    link, a name and an address read from each piece; pieces without a name, an
    address or a readable block are dropped."""
    pieces = F.slice(F.split("html", link), 2, 2**31 - 1)
    cut = pages.select("page_id", F.posexplode(pieces).alias("pos", "piece"))
    read = cut.select(
        "page_id", "pos", trim_space(F.regexp_extract("piece", name, 1)).alias("name"),
        trim_space(F.regexp_extract("piece", address, 1)).alias("address"), F.lit(source).alias("source"),
    )
    return read.filter((F.col("name") != "") & (F.col("address") != "") & block_key_text(F.col("address")).isNotNull())


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """U4: a building listed on several pages counts once, at its first place."""
    return first_wins(candidates, ["name", "address"], ["page_id", "pos"])


def chome_links(pages: DataFrame, city_slug: str, origin: str, pattern: str | None = None) -> DataFrame:
    """(url, town, chome) of index pages; the first mention of a url wins."""
    gap = f"[{SPACE_CLASS}]*"
    pattern = pattern or f'href="([^"]*?/archive/list/tokyo/{re.escape(city_slug)}/[^"]*?-addr/)"[^>]*>{gap}<span[^>]*>([^<]+)</span>'
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), 1).alias("url"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "l")).select("page_id", "pos", "l.url", _half_width(F.col("l.label")).alias("label"))
    shape = "^(.+?)([0-9]+|[一二三四五六七八九十]+)丁目$"
    read = rows.filter(F.col("label").rlike(shape)).select(
        "page_id", "pos", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit(origin), "url")).alias("url"),
        F.regexp_extract("label", shape, 1).alias("town"), _chome_number(F.regexp_extract("label", shape, 2)).alias("chome"),
    ).filter("chome is not null")
    return first_wins(read, ["url"], ["page_id", "pos"]).select("url", "town", "chome")


# -- configurable extraction ------------------------------------------------------
# A selector is a list of steps; a step is tag, class or id, as in "article p",
# "div.item", "#list li".  Commas give alternatives.


class _Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts, self.children = [], []

    # Pages may nest thousands of tags: both walk with a stack.
    def text(self) -> str:
        out, left = [], [self]
        while left:
            part = left.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                left.extend(reversed(part.parts))
        return "".join(out)

    def walk(self):
        left = self.children[::-1]
        while left:
            node = left.pop()
            yield node
            left.extend(reversed(node.children))


class _Tree(HTMLParser):
    VOID = set("area base br col embed hr img input link meta source track wbr".split())
    # An opening tag that ends an open one of the listed kinds.
    CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.here.tag in self.CLOSES.get(tag, ()):
            self.here = self.here.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        self.here.parts.append(node)
        if tag not in self.VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.parts.append(data)


_STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def _step(text: str):
    tag, rest = _STEP.fullmatch(text).groups()
    marks = re.findall(r"([.#])([\w-]+)", rest)
    attrs = re.findall(r"\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", rest)
    return tag, marks, attrs


def _fits(node: _Node, step) -> bool:
    tag, marks, attrs = step
    classes = node.attrs.get("class", "").split()
    return (
        (tag in (None, "*") or node.tag == tag)
        and all(v in classes if m == "." else node.attrs.get("id") == v for m, v in marks)
        and all(k in node.attrs and (v == "" or node.attrs[k] == v) for k, v in attrs)
    )


def _select(scope: _Node, selector: str) -> list[_Node]:
    paths = [[_step(s) for s in alt.split()] for alt in selector.split(",") if alt.strip()]

    def matches(node: _Node, path) -> bool:
        if not _fits(node, path[-1]):
            return False
        up, need = node.parent, len(path) - 2
        while need >= 0 and up is not None:
            need -= _fits(up, path[need])
            up = up.parent
        return need < 0

    return [n for n in scope.walk() if any(matches(n, p) for p in paths)]


def _read_field(item: _Node, rule: dict) -> str | None:
    found = _select(item, rule["selector"])[:1] if rule.get("selector") else [item]
    if not found:
        return None
    raw = found[0].attrs.get(rule["attribute"]) if rule.get("attribute") else found[0].text()
    value = re.sub(r"[\s﻿]+", " ", raw or "").strip()
    if value and rule.get("pattern"):
        try:
            hit = re.search(rule["pattern"], value)
        except re.error:  # a broken rule gives up its own field only
            return None
        value = ((hit.group(1) if hit.re.groups and hit.group(1) is not None else hit.group(0)).strip()) if hit else ""
    return value or None


def extract_items(pages: DataFrame, item_selector: str, fields: dict[str, dict], next_selector: str | None = None) -> DataFrame:
    """One row per item of each page: (page_id, url, pos, <fields>, next_page_url, item_count).

    ``fields``: name -> {selector, attribute?, pattern?}; a missing value is
    NULL.  Pages are parsed one by one where they lie, and their rows go out in
    small batches; the rules are a small dictionary that travels with the job.
    """
    names = list(fields)
    columns = ["page_id", "url", "pos", *names, "next_page_url", "item_count"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                tree = _Tree()
                tree.feed(html or "")
                items = _select(tree.root, item_selector)
                links = _select(tree.root, next_selector)[:1] if next_selector else []
                href = links[0].attrs.get("href") if links else None
                following = urljoin(url, href) if href else None
                for pos, item in enumerate(items):
                    out.append((page_id, url, pos, *[_read_field(item, fields[n]) for n in names], following, len(items)))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    schema = "page_id bigint, url string, pos int, " + "".join(f"`{n}` string, " for n in names) + "next_page_url string, item_count int"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, schema)


def listing_records(items: DataFrame, source_id: str) -> DataFrame:
    """Extracted items -> source records; items without an address are dropped."""
    have = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    staged = items.filter(have("address").isNotNull()).withColumn("_p", address_parts(F.col("address")))
    link = have("detail_url")
    base = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    full = F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(base, link)).otherwise(
        F.concat(F.regexp_replace("url", "[^/]*([?#].*)?$", ""), link))
    return staged.select(
        "page_id", "pos", F.when(link.isNotNull(), F.concat(F.lit(f"{source_id}:"), full)).alias("source_ref"),
        F.coalesce(have("building_name"), F.lit(vocab.BLANK_NAME)).alias("building_name"), "address",
        *[F.coalesce(have(c), F.col(f"_p.{c}")).alias(c) for c in ("prefecture", "city", "town")],
        parse.property_type_of_source(have("property_type")).alias("property_type"),
        F.coalesce(have("building_use"), have("property_type")).alias("building_use_raw"),
        parse.count_of_source(have("total_units")).alias("total_units"),
        parse.coordinate(have("latitude"), "latitude").alias("latitude"),
        parse.coordinate(have("longitude"), "longitude").alias("longitude"),
    )


def distinct_records(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Records of a crawl, each (source id, address, name) once; the optional
    limit is the crawl's own politeness setting."""
    unique = first_wins(records, ["source_ref", "address", "building_name"], ["page_id", "pos"])
    return unique if limit is None else unique.orderBy("page_id", "pos").limit(limit)


def town_index(pages: DataFrame, item_selector: str) -> DataFrame:
    """Distinct towns of index pages, a trailing count in brackets removed."""
    items = extract_items(pages, item_selector, {"raw": {"selector": ""}})
    name = trim_space(F.regexp_replace("raw", f"[（(][^（()）]*[)）][{SPACE_CLASS}]*$", ""))
    return items.select(name.alias("town")).filter("town <> ''").distinct().orderBy("town")
