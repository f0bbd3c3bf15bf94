"""Building-use classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.text import literal_list, literal_map, nfkc, trim_space

MULTI, EXCLUDED = "RESIDENTIAL_MULTI", "EXCLUDED"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def _label(category: Column) -> Column:
    return _lookup(vocab.USE_LABELS, category)


def tag_category(tag: Column) -> Column:
    """Category of a map ``building`` tag value, NULL when unknown."""
    return _lookup(vocab.USE_TAG_CATEGORY, F.lower(trim_space(tag)))


def first_term(text: Column) -> Column:
    """First term found, excluding terms before residential ones, list order."""
    terms = [t for t, _ in vocab.EXCLUDING_TERMS] + vocab.RESIDENTIAL_TERMS
    found = F.filter(literal_list(terms), lambda t: F.contains(text, t))
    return F.try_element_at(found, F.lit(1))


def term_category(term: Column) -> Column:
    table = dict(vocab.EXCLUDING_TERMS) | {t: "residential_multi" for t in vocab.RESIDENTIAL_TERMS}
    return _lookup(table, term)


def with_use(df: DataFrame, value: str, name: str, out: str = "use") -> DataFrame:
    """Add struct(use, term, category, reason, unknown).

    The map tag decides first, then Japanese terms in the use value, then terms
    in the building name.  What none of them decides is excluded as unknown.
    Worked in steps, so that each intermediate value is computed once.
    """
    raw, tag_cat, value_term, term, category = (
        F.col(f"_use_{c}") for c in ("raw", "tag_cat", "value_term", "term", "category")
    )
    vague = tag_cat == "ambiguous"
    steps = df.withColumns(
        {"_use_raw": trim_space(nfkc(F.coalesce(F.col(value), F.lit("")))), "_use_name": nfkc(F.col(name))}
    ).withColumn("_use_tag_cat", tag_category(raw))
    steps = steps.withColumn("_use_value_term", F.when(tag_cat.isNull() | vague, first_term(raw)))
    steps = steps.withColumn("_use_term", F.coalesce(value_term, first_term(F.col("_use_name"))))
    steps = steps.withColumn("_use_category", term_category(term))

    tag = F.lower(raw)
    multi = category == "residential_multi"
    settled = tag_cat.isNotNull() & ~vague
    via = F.when(vague, F.concat(F.lit("building="), tag, F.lit(" だが、"))).otherwise("")
    tag_reason = F.concat(
        F.lit("building="), tag, F.lit("（"), _label(tag_cat),
        F.when(tag_cat == "residential_multi", "）").otherwise("）のため対象外"),
    )
    value_reason = F.concat(
        F.lit("「"), term, F.lit("」を含むため"),
        F.when(multi, "集合住宅と判断").otherwise(F.concat(_label(category), F.lit("として対象外"))),
    )
    name_reason = F.concat(
        via, F.lit("建物名「"), F.col(name), F.lit("」に「"), term, F.lit("」が含まれるため"),
        F.when(multi, "集合住宅と判断").otherwise("対象外"),
    )
    vague_reason = F.concat(
        F.lit("building="), tag, F.lit(" は集合住宅と特定できず、建物名からも判断できないため対象外")
    )
    raw_reason = F.concat(F.lit("用途「"), raw, F.lit("」から集合住宅と判断できないため対象外"))
    decided = F.when(settled, tag_cat).when(term.isNotNull(), category)
    judged = F.struct(
        F.when(decided == "residential_multi", MULTI).otherwise(EXCLUDED).alias("use"),
        F.when(settled, tag).when(term.isNotNull(), term).when(vague, tag).when(raw != "", raw).alias("term"),
        F.coalesce(decided, F.lit("ambiguous")).alias("category"),
        F.when(settled, tag_reason)
        .when(value_term.isNotNull(), value_reason)
        .when(term.isNotNull(), name_reason)
        .when(vague, vague_reason)
        .when(raw != "", raw_reason)
        .otherwise("用途を判定できないため対象外")
        .alias("reason"),
        decided.isNull().alias("unknown"),
    )
    return steps.withColumn(out, judged).drop(
        "_use_raw", "_use_name", "_use_tag_cat", "_use_value_term", "_use_term", "_use_category"
    )
