"""Address functions: normal form, parts, block key, canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.text import char_class, extract, nfkc, noise_class, strip_space, trim_space

_K = vocab.KANJI_DIGITS
_UNIT = "(?=丁目|丁|番地|番|号|条)"


def _kanji_numerals(text: Column) -> Column:
    """Kanji numerals (up to 99, or digit by digit) before a block suffix -> digits.

    The run is fenced with control characters so that digits elsewhere in the
    address ("三軒茶屋") stay as they are.  A run this cannot read as a number,
    such as one with two digits before 十, is left alone.
    """
    run = f"[{_K}十]"
    alone = f"(?<!{run})"
    one = f"([{_K}])"
    out = text
    for pattern, fenced in (
        (f"{alone}{one}十{one}{_UNIT}", "\x01$1$2\x02"),
        (f"{alone}十{one}{_UNIT}", "\x01一$1\x02"),
        (f"{alone}{one}十{_UNIT}", "\x01$1〇\x02"),
        (f"{alone}十{_UNIT}", "\x01一〇\x02"),
        (f"{alone}([{_K}]+){_UNIT}", "\x01$1\x02"),
    ):
        out = F.regexp_replace(out, pattern, fenced)
    for kanji, digit in zip(_K, vocab.KANJI_DIGIT_VALUES):
        out = F.regexp_replace(out, f"{kanji}(?=[0-9{_K}]*\x02)", digit)
    # A number has no leading zero: 〇五丁目 reads as 5.
    out = F.regexp_replace(out, "\x01(?:0+(?=[0-9]))?([0-9]+)\x02", "$1")
    return F.when(text.rlike(f"{run}{_UNIT}"), out).otherwise(text)


def _normal_text(address: Column) -> Column:
    text = F.translate(nfkc(address), vocab.ADDRESS_DASHES, "-" * len(vocab.ADDRESS_DASHES))
    return trim_space(text)


def _without_prefecture(text: Column) -> Column:
    body = F.regexp_replace(text, vocab.PREFECTURE_PATTERN, "")
    return F.regexp_replace(body, "大字|小字", "")


def _fold_body(body: Column) -> Column:
    gap = f"[{vocab.SPACE_CLASS}]*"
    body = F.regexp_replace(body, f"([0-9]){gap}(?:丁目|番地|番|号室|号|条)", "$1-")
    body = F.lower(F.regexp_replace(body, noise_class(vocab.ADDRESS_NOISE), ""))
    return F.regexp_replace(F.regexp_replace(body, "-{2,}", "-"), "^-|-$", "")


def _shape(body: Column, prefecture: Column) -> Column:
    shape = "^([^0-9]*)([0-9]+(?:-[0-9]+)*)(.*)$"
    readable = body.rlike(shape)
    locality, digits, rest = (F.regexp_extract(body, shape, i) for i in (1, 2, 3))
    has_extra = rest.rlike("^[^-0-9]")  # '' when the shape does not match
    return F.struct(
        F.when(has_extra, F.concat(locality, digits)).otherwise(body).alias("normalized"),
        F.when(has_extra, rest).otherwise("").alias("extra"),
        F.when(readable, locality).otherwise(body).alias("locality"),
        F.when(readable, F.split(digits, "-").try_cast("array<int>"))
        .otherwise(F.array().cast("array<int>"))
        .alias("blocks"),
        prefecture.alias("prefecture"),
    )


def normalize_address(address: Column) -> Column:
    """struct(normalized, extra, locality, blocks, prefecture).

    NULL or blank input gives the empty form, never NULL.  For a whole table,
    :func:`with_address` computes the same in steps.
    """
    text = _normal_text(F.coalesce(address, F.lit("")))
    body = _fold_body(_kanji_numerals(_without_prefecture(text)))
    return _shape(body, extract(text, vocab.PREFECTURE_PATTERN))


def with_address(df: DataFrame, address: str = "address", out: str = "addr") -> DataFrame:
    """P1 as a column of ``df``; steps keep each intermediate text computed once."""
    text, body = F.col("_addr_text"), F.col("_addr_body")
    return (
        df.withColumn("_addr_text", _normal_text(F.coalesce(F.col(address), F.lit(""))))
        .withColumn("_addr_body", _without_prefecture(text))
        .withColumn("_addr_body", _fold_body(_kanji_numerals(body)))
        .withColumn(out, _shape(body, extract(text, vocab.PREFECTURE_PATTERN)))
        .drop("_addr_text", "_addr_body")
    )


def address_parts(address: Column) -> Column:
    """struct(prefecture, city, town); a part that cannot be read is NULL."""
    text = strip_space(nfkc(address))
    prefecture = extract(text, vocab.PREFECTURE_PATTERN)
    body = F.regexp_replace(text, vocab.PREFECTURE_PATTERN, "")
    city_pattern = "^(.+?郡.+?[町村]|.+?[市区町村])"
    city = extract(body, city_pattern)
    rest = F.regexp_replace(body, city_pattern, "")
    numeral = f"0-9{_K}十"
    town = extract(rest, f"^([^{numeral}]+?)(?=[{numeral}]|$)")
    return F.struct(prefecture.alias("prefecture"), city.alias("city"), town.alias("town"))


def city_of(address: Column) -> Column:
    """City from a free address, NULL if absent."""
    return extract(address, f"([^{vocab.SPACE_CLASS}都道府県]+?[市区町村])")


def _half_width(address: Column) -> Column:
    dashes = "-" * len(vocab.BLOCK_DASHES)
    text = F.translate(address, "０１２３４５６７８９" + vocab.BLOCK_DASHES, "0123456789" + dashes)
    return strip_space(text)


def _chome_number(text: Column) -> Column:
    """"三" / "十一" / "3" -> 3 / 11 / 3; NULL when not a positive number."""
    digits = F.translate(text, "一二三四五六七八九", "123456789")
    teens = F.regexp_extract(digits, "^十([1-9]?)$", 1)
    number = F.when(
        digits.rlike("^十[1-9]?$"), F.concat(F.lit("1"), F.when(teens == "", "0").otherwise(teens))
    ).otherwise(digits)
    value = number.try_cast("int")
    return F.when(value > 0, value)


def block_key(address: Column) -> Column:
    """struct(city, town, chome, block), NULL when the block is unreadable."""
    text = F.regexp_replace(_half_width(address), vocab.LOOSE_PREFECTURE_PATTERN, "")
    city_pattern = "^([^市区町村]+[市区町村])"
    city = F.regexp_extract(text, city_pattern, 1)
    body = F.regexp_replace(text, city_pattern, "")
    worded = "^(.+?)([0-9]+|[一二三四五六七八九十]+)丁目-?([0-9]+)"
    dashed = "^(.+?)([0-9]+)-([0-9]+)"
    is_worded = body.rlike(worded)
    chome = F.when(is_worded, _chome_number(F.regexp_extract(body, worded, 2))).otherwise(
        F.regexp_extract(body, dashed, 2).try_cast("int")
    )
    pick = lambda group: F.when(is_worded, F.regexp_extract(body, worded, group)).otherwise(
        F.regexp_extract(body, dashed, group)
    )
    key = F.struct(
        city.alias("city"),
        pick(1).alias("town"),
        chome.alias("chome"),
        pick(3).try_cast("int").alias("block"),
    )
    return F.when((is_worded | body.rlike(dashed)) & chome.isNotNull(), key)


def block_key_text(address: Column) -> Column:
    """``city/town/chome/block``, NULL when unreadable."""
    key = block_key(address)
    return F.when(
        key.isNotNull(), F.concat_ws("/", key["city"], key["town"], key["chome"], key["block"])
    )


def canonical_address(address: Column) -> Column:
    """P5: the comparison form of researched addresses (keeps the city)."""
    text = F.translate(address, "０１２３４５６７８９", "0123456789")
    text = F.regexp_replace(text, vocab.LOOSE_PREFECTURE_PATTERN, "")
    # 一 .. 九, 十 .. 十九 before 丁目; other runs are not numbers and stay.
    alone, end = "(?<![一二三四五六七八九十])", "(?=丁目)"
    text = F.regexp_replace(text, f"{alone}十([一二三四五六七八九]){end}", "\x01一$1\x02")
    text = F.regexp_replace(text, f"{alone}十{end}", "\x01一〇\x02")
    text = F.regexp_replace(text, f"{alone}([一二三四五六七八九]+){end}", "\x01$1\x02")
    for kanji, digit in zip(_K, vocab.KANJI_DIGIT_VALUES):
        text = F.regexp_replace(text, f"{kanji}(?=[0-9{_K}]*\x02)", digit)
    text = F.regexp_replace(text, "[\x01\x02]", "")
    dashed = vocab.BLOCK_DASHES + "丁目番地"
    text = strip_space(F.translate(text, dashed + "号", "-" * len(dashed)))
    return F.regexp_replace(F.regexp_replace(text, "-+", "-"), "-$", "")


def with_prefecture_backfill(
    df: DataFrame, city: str = "city", prefecture: str = "prefecture", master: dict | None = None
) -> DataFrame:
    """Fill a missing prefecture from the city when only one has that city.

    The area master is a fixed list (a few thousand municipalities at most), so
    the lookup is a literal map and needs no join.
    """
    return df.withColumn(prefecture, F.coalesce(F.col(prefecture), prefecture_of_city(F.col(city), master)))


def with_prefecture_from(df: DataFrame, areas: DataFrame, city: str = "city", prefecture: str = "prefecture") -> DataFrame:
    """P3 from an area table (``prefecture``, ``city``; rows may repeat), by a join with the cities of one prefecture.

    Null cities and cities that the table lacks or has under two prefectures fill nothing.
    """
    one = areas.groupBy(F.col("city").alias("_city")).agg(F.min("prefecture").alias("_one"), F.max("prefecture").alias("_other"))
    one = one.filter(F.col("_one") == F.col("_other")).select("_city", "_one")
    filled = df.join(one, df[city] == F.col("_city"), "left").withColumn(prefecture, F.coalesce(F.col(prefecture), F.col("_one")))
    return filled.drop("_city", "_one")


def prefecture_of_city(city: Column, master: dict | None = None) -> Column:
    owners: dict[str, set[str]] = {}
    for name, cities in (master or vocab.AREA_MASTER).items():
        for c in cities:
            owners.setdefault(c, set()).add(name)
    unique = {c: next(iter(p)) for c, p in owners.items() if len(p) == 1}
    if not unique:
        return F.lit(None).cast("string")
    by_prefecture: dict[str, list[str]] = {}
    for c, p in unique.items():
        by_prefecture.setdefault(p, []).append(c)
    out = F.lit(None).cast("string")
    for name, cities in by_prefecture.items():
        out = F.when(city.isin(cities), F.lit(name)).otherwise(out)
    return out


__all__ = [
    "address_parts", "block_key", "block_key_text", "canonical_address", "char_class", "city_of",
    "normalize_address", "prefecture_of_city", "with_address", "with_prefecture_backfill", "with_prefecture_from",
]
