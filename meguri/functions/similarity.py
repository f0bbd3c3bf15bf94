"""String-pair and address-pair similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _both_empty(a: Column, b: Column) -> Column:
    return (F.length(a) == 0) & (F.length(b) == 0)


def _one_empty(a: Column, b: Column) -> Column:
    return (F.length(a) == 0) | (F.length(b) == 0)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """(max - distance) / max; both empty 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(_both_empty(a, b), 1.0)
        .when(_one_empty(a, b), 0.0)
        .otherwise((longest - F.levenshtein(a, b)) / longest)
    )


def _multiset_overlap(a: Column, b: Column) -> Column:
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x))
    )


def token_dice(a: Column, b: Column) -> Column:
    """Multiset Dice of two arrays; both empty 1, one empty 0."""
    sizes = F.size(a) + F.size(b)
    return (
        F.when(sizes == 0, 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(2 * _multiset_overlap(a, b) / sizes)
    )


def bigrams(text: Column) -> Column:
    starts = F.when(F.length(text) >= 2, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: text.substr(i, F.lit(2)))


def bigram_dice(a: Column, b: Column) -> Column:
    """Multiset Dice over character bigrams."""
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) < 2) | (F.length(b) < 2), 0.0)
        .otherwise(token_dice(bigrams(a), bigrams(b)))
    )


def is_token_prefix(a: Column, b: Column) -> Column:
    """A is a non-empty leading part of b."""
    return (F.size(a) > 0) & (F.size(a) <= F.size(b)) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(1))) == a)


def _jaro_winkler_pair(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    hits = []  # (position in b) of each matched character of a, in a's order
    matched = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] == ch:
                free[j] = None
                hits.append(j)
                matched.append(ch)
                break
    m = len(hits)
    if m == 0:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(matched, sorted(hits))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler (prefix 4, weight 0.1); Spark has no built-in for it."""
    return pd.Series(
        [None if x is None or y is None else _jaro_winkler_pair(x, y) for x, y in zip(a, b)],
        dtype="float64",
    )


SCORE_CAP = 0.98  # below the "same name" threshold of 0.99 unless equal
JARO_WEIGHT = 0.95
SKELETON_SCORE = 0.95


def compared_names(a: Column, b: Column) -> tuple[Column, Column]:
    """The forms that are compared: canonical, or the surface if either canonical form is empty."""
    bare = (F.length(a["canonical"]) == 0) | (F.length(b["canonical"]) == 0)
    return tuple(F.when(bare, n["normalized"]).otherwise(n["canonical"]) for n in (a, b))


def name_similarity(a: Column, b: Column) -> Column:
    """struct(score, token_exact, translit) of two name-feature structs.

    1 for equal canonical names; otherwise the best of the edit ratio, 0.95 x
    Jaro-Winkler of the canonical names, and 0.95 for equal consonant
    skeletons, kept under 0.98.  An empty name scores 0 against everything.  A
    name made of common words only has no canonical form; it and what it is
    compared with count by their surface forms.

    The Jaro-Winkler UDF gets NULL for pairs already decided without it.
    """
    x, y = compared_names(a, b)
    usable = (F.length(a["normalized"]) > 0) & (F.length(b["normalized"]) > 0)
    exact = usable & (x == y) & (F.length(x) > 0)
    skeleton = (a["skeleton"] == b["skeleton"]) & (F.length(a["skeleton"]) > 0)
    edit = levenshtein_ratio(x, y)
    undecided = usable & ~exact & ~skeleton
    jaro = jaro_winkler(F.when(undecided, x), F.when(undecided, y))
    best = F.greatest(edit, F.coalesce(jaro, F.lit(0.0)) * JARO_WEIGHT, F.when(skeleton, SKELETON_SCORE).otherwise(0.0))
    score = F.when(exact, 1.0).when(usable, F.least(best, F.lit(SCORE_CAP))).otherwise(0.0)
    return F.struct(
        score.alias("score"),
        exact.alias("token_exact"),
        (exact & (a["normalized"] != b["normalized"])).alias("translit"),
    )


def round4(value: Column) -> Column:
    return F.floor(value * 10000 + 0.5) / 10000


def same_locality(a: Column, b: Column) -> Column:
    """Equal, or the shorter (3+ characters) ends the longer; empty never matches."""
    suffix = lambda short, long: (F.length(short) >= 3) & long.endswith(short)
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | suffix(a, b) | suffix(b, a))


def common_depth(a: Column, b: Column) -> Column:
    """How many leading block numbers agree."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    differs = F.transform(pairs, lambda p: ~p["a"].eqNullSafe(p["b"]))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(pairs)).cast("int")


def block_relation(a: Column, b: Column, depth: Column | None = None) -> Column:
    depth = common_depth(a, b) if depth is None else depth
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown")
        .when((depth == F.size(a)) & (depth == F.size(b)), "equal")
        .when(depth == F.least(F.size(a), F.size(b)), "prefix")
        .otherwise("divergent")
    )


APART = 0.5  # of the likeness of localities that do not agree


def address_score(a: Column, b: Column, exact: Column, local: Column, relation: Column, depth: Column) -> Column:
    share = depth / F.greatest(F.size(a["blocks"]), F.size(b["blocks"]), F.lit(1))
    return (
        F.when(exact, 1.0)
        .when(~local, levenshtein_ratio(a["locality"], b["locality"]) * APART)
        .when(relation == "equal", 0.97)
        .when(relation == "prefix", 0.85 + 0.1 * share)
        .when(relation == "divergent", 0.45 + 0.25 * share)
        .otherwise(0.6)
    )


def address_similarity(a: Column, b: Column) -> Column:
    """Compare two P1 structs.

    struct(score, exact, locality_match, locality_similarity, relation, depth)
    """
    exact = (F.length(a["normalized"]) > 0) & (a["normalized"] == b["normalized"])
    local = same_locality(a["locality"], b["locality"])
    depth = common_depth(a["blocks"], b["blocks"])
    relation = block_relation(a["blocks"], b["blocks"], depth)
    return F.struct(
        round4(address_score(a, b, exact, local, relation, depth)).alias("score"),
        exact.alias("exact"),
        local.alias("locality_match"),
        round4(levenshtein_ratio(a["locality"], b["locality"])).alias("locality_similarity"),
        relation.alias("relation"),
        F.when(relation == "unknown", 0).otherwise(depth).alias("depth"),
    )
