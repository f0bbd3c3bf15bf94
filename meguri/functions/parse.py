"""Readers of single values: units, types, dates, coordinates, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.text import SPACE_CLASS, blank_to_null, extract, nfkc, trim_space


def _has(text: Column, *words: str) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def property_type_of_source(value: Column) -> Column:
    """P10: property type of a source record."""
    text = F.lower(nfkc(F.coalesce(value, F.lit(""))))
    return (
        F.when(_has(text, "賃貸", "rental", "rent"), "rental")
        .when(_has(text, "分譲", "condo", "owner"), "condominium")
        .otherwise("unknown")
    )


def property_type_of_import(value: Column) -> Column:
    """Property type in a distribution list."""
    text = F.lower(nfkc(F.coalesce(value, F.lit(""))))
    return (
        F.when(_has(text, "賃貸", "rental", "賃"), "rental")
        .when(_has(text, "分譲", "condo", "持家"), "condominium")
        .otherwise("unknown")
    )


def _outcome(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"))


def property_type_of_research(value: Column) -> Column:
    """struct(value, error); both NULL when the cell is blank."""
    text = trim_space(F.coalesce(value, F.lit("")))
    lowered = F.lower(text)
    rental = text.contains("賃貸") | lowered.contains("rental")
    condo = text.contains("分譲") | lowered.contains("condominium")
    exact = F.lit(None).cast("string")
    for kind, words in (
        ("rental", ["賃貸", "rental"]),
        ("condominium", ["分譲", "condominium"]),
        ("unknown", ["不明", "unknown"]),
    ):
        exact = F.when(text.isin(words), F.lit(kind)).otherwise(exact)
    quoted = lambda tail: F.concat(F.lit("物件種別「"), text, F.lit("」は" + tail))
    value_col = F.coalesce(
        exact, F.when(rental & ~condo, "rental").when(condo & ~rental, "condominium")
    )
    error = (
        F.when((text == "") | value_col.isNotNull(), F.lit(None))
        .when(rental & condo, quoted("賃貸と分譲の両方を含んでいて判断できません。"))
        .otherwise(quoted("既存の区分（賃貸 / 分譲 / 不明）に当てはまりません。"))
    )
    return _outcome(value_col, error)


def count_of_source(value: Column) -> Column:
    """Lenient unit count; text without a number is unknown, not 0."""
    number = F.regexp_replace(value, "[^0-9.\\-]", "").try_cast("double")
    return F.when(number >= 0, F.floor(number).cast("int"))


def count_of_import(value: Column) -> Column:
    """First run of digits."""
    return extract(nfkc(value), "([0-9]+)").try_cast("int")


def count_of_research(value: Column) -> Column:
    """struct(value, error); only a positive whole number counts."""
    text = trim_space(F.coalesce(value, F.lit("")))
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    quoted = lambda tail: F.concat(F.lit("総世帯数「"), text, F.lit("」は" + tail))
    error = (
        F.when((text == "") | (number > 0), F.lit(None))
        .when(~text.rlike("^[0-9]+$"), quoted("数値ではありません。"))
        .otherwise(quoted(" 1 以上である必要があります。"))
    )
    return _outcome(F.when(number > 0, number), error)


def coordinate(value: Column, kind: str) -> Column:
    """Coordinate within range (``latitude`` or ``longitude``), else NULL."""
    number = value.try_cast("double")
    limit = 90.0 if kind == "latitude" else 180.0
    return F.when(F.abs(number) <= limit, number)


def coordinate_unbounded(value: Column) -> Column:
    number = trim_space(nfkc(value)).try_cast("double")
    finite = ~F.isnan(number) & ~number.isin(float("inf"), float("-inf"))
    return F.when(finite, number)


def date_of_import(value: Column) -> Column:
    """Year-month-day with dashes, slashes, dots or 年月日; else NULL."""
    gap = f"[{SPACE_CLASS}]*"
    pattern = f"([0-9]{{4}}){gap}[-/年.]{gap}([0-9]{{1,2}}){gap}[-/月.]{gap}([0-9]{{1,2}})"
    text = nfkc(value)
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def research_source(value: Column) -> Column:
    """struct(value, error) against the list of allowed research sources."""
    raw = trim_space(F.coalesce(value, F.lit("")))
    text = F.regexp_replace(F.lower(raw), f"[{SPACE_CLASS}\\-]+", "_")
    allowed = " / ".join(vocab.RESEARCH_SOURCES)
    error = (
        F.when(text == "", F.lit(f"source が未記入です。{allowed} のいずれかを記入してください。"))
        .when(
            ~text.isin(vocab.RESEARCH_SOURCES),
            F.concat(F.lit("source「"), raw, F.lit(f"」は使えません。{allowed} のいずれかを記入してください。")),
        )
    )
    return _outcome(F.when(text.isin(vocab.RESEARCH_SOURCES), text), error)


def is_development(source_ref: Column) -> Column:
    """Rows from a development source."""
    return F.coalesce(source_ref.rlike("^mock[-:]"), F.lit(False))


def dataset_id(file_name: Column) -> Column:
    """Safe dataset id from a file name or path."""
    base = F.regexp_replace(F.regexp_replace(file_name, "^.*/", ""), "\\.[^.]+$", "")
    safe = F.regexp_replace(base, "[^\\p{L}\\p{N}_-]+", "-")
    safe = F.regexp_replace(safe, "^-+|-+$", "")
    return F.coalesce(blank_to_null(safe), F.lit("dataset"))


def percent_text(score: Column) -> Column:
    """P25: 0.947 -> '95%' (halves go up)."""
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def metres_text(distance: Column) -> Column:
    return F.concat(F.floor(distance + 0.5).cast("string"), F.lit("m"))
