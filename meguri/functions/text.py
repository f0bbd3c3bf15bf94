"""Text folding shared by the address and name functions.

Spark has no built-in NFKC, so :func:`nfkc` is the one Arrow UDF every text
column passes through; it is handed NULL for text that folding cannot change,
so on an already folded column no text crosses to Python.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from meguri.functions.vocab import SPACE_CLASS

# Hiragana, katakana (without the composing marks), common kanji, ASCII: NFKC
# leaves each of these characters, and any run of them, as it is.
_STABLE = r"^[\x00-\x7Fぁ-ゖァ-ヺー一-鿿〇々、。「」・−–—―‐]*$"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Full-width ASCII, the commonest case, is folded on the JVM."""
    widened = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    folded = F.translate(text, widened, plain)
    stable = folded.rlike(_STABLE)
    return F.when(stable, folded).otherwise(_nfkc(F.when(~stable, text)))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim_space(text), F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def char_class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def noise_class(chars: str) -> str:
    """Character class of punctuation plus white space."""
    return "[" + "".join(re.escape(c) for c in chars) + SPACE_CLASS + "]"


def literal_map(table: dict[str, str]) -> Column:
    """A constant lookup table (folded by Spark; built in one call)."""
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def literal_list(values: list[str]) -> Column:
    """A constant array of texts (folded by Spark; built in one call)."""
    return F.split(F.lit("\x1e".join(values)), "\x1e")
