"""Building-name functions: surface form, tokens, romanization, skeleton."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions import vocab
from meguri.functions.text import literal_map, nfkc, noise_class, trim_space

_VOWELS = "aiueo"


# Katakana unit (one or two characters) -> romaji (fixed values).
_KANA = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o", "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko",
    "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go", "サ": "sa", "シ": "shi", "ス": "su", "セ": "se",
    "ソ": "so", "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo", "タ": "ta", "チ": "chi", "ツ": "tsu",
    "テ": "te", "ト": "to", "ダ": "da", "ヂ": "ji", "ヅ": "zu", "デ": "de", "ド": "do", "ナ": "na", "ニ": "ni",
    "ヌ": "nu", "ネ": "ne", "ノ": "no", "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho", "バ": "ba",
    "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo", "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo", "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re",
    "ロ": "ro", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヰ": "i", "ヱ": "e", "ヲ": "o", "ン": "n", "ァ": "a",
    "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo", "ヮ": "wa", "キャ": "kya",
    "キュ": "kyu", "キョ": "kyo", "ギャ": "gya", "ギュ": "gyu", "ギョ": "gyo", "ニャ": "nya", "ニュ": "nyu", "ニョ": "nyo",
    "ヒャ": "hya", "ヒュ": "hyu", "ヒョ": "hyo", "ビャ": "bya", "ビュ": "byu", "ビョ": "byo", "ピャ": "pya", "ピュ": "pyu",
    "ピョ": "pyo", "ミャ": "mya", "ミュ": "myu", "ミョ": "myo", "リャ": "rya", "リュ": "ryu", "リョ": "ryo", "シャ": "sha",
    "シュ": "shu", "ショ": "sho", "シェ": "she", "ジャ": "ja", "ジュ": "ju", "ジョ": "jo", "ジェ": "je", "チャ": "cha",
    "チュ": "chu", "チョ": "cho", "チェ": "che", "ファ": "fa", "フィ": "fi", "フェ": "fe", "フォ": "fo", "ツァ": "tsa",
    "ツィ": "tsi", "ツェ": "tse", "ツォ": "tso", "クァ": "kwa", "クィ": "kwi", "クェ": "kwe", "クォ": "kwo", "ウィ": "wi",
    "ウェ": "we", "ウォ": "wo", "ティ": "ti", "テュ": "tyu", "ディ": "di", "デュ": "dyu", "キェ": "kye", "ギェ": "gye",
    "フュ": "fyu", "グァ": "gwa", "トゥ": "tu", "ドゥ": "du",
}
_PAIRS = "|".join(k for k in _KANA if len(k) == 2)
_ROMANIZED = "[\u3041-\u30ff\uff0d-]"  # kana, the marks between them, and dashes
_UNIT = f"(ッ?(?:{_PAIRS})|ッ?[{''.join(k for k in _KANA if len(k) == 1)}]|[\\s\\S])"


def _fold_katakana(text: Column) -> Column:
    """Hiragana -> katakana; spellings of the v-sounds that are read alike -> b-row."""
    hiragana = "".join(chr(c) for c in range(0x3041, 0x3097))
    katakana = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
    out = F.translate(text, hiragana + "ヷヸヹヺヽヾゝゞ", katakana + "バビベボ")
    for small, row in zip("ァィェォ", "バビベボ"):
        out = F.replace(out, F.lit("ヴ" + small), F.lit(row))
    return F.replace(out, F.lit("ヴ"), F.lit("ブ"))


def normalize_name(name: Column) -> Column:
    """Surface form used as the comparison key ('' for NULL or blank)."""
    text = _fold_katakana(nfkc(F.coalesce(name, F.lit(""))))
    text = F.lower(F.regexp_replace(text, noise_class(vocab.NAME_NOISE), ""))
    return F.regexp_replace(text, vocab.UNIT_SUFFIX_PATTERN, "")


def katakana_to_romaji(text: Column) -> Column:
    """Romanize katakana; other characters stay, long-vowel marks go."""
    units = F.regexp_extract_all(_fold_katakana(text), F.lit(_UNIT), 1)
    table = literal_map(_KANA)
    kana = text.rlike(_ROMANIZED)  # without any of these the text stays as it is

    def romanize(unit: Column) -> Column:
        # A small tsu doubles the next consonant (ch is doubled with t).
        rest = F.try_element_at(table, F.substring(unit, 2, 2))
        first = F.substring(rest, 1, 1)
        doubled = F.when(first.isin(*_VOWELS), "").when(first == "c", "t").otherwise(first)
        return (
            F.when(unit.isin("ー", "－", "-", "ッ"), "")
            .when(unit.startswith("ッ"), F.concat(doubled, rest))
            .otherwise(F.coalesce(F.try_element_at(table, unit), unit))
        )

    return F.when(kana, F.array_join(F.transform(units, romanize), "")).otherwise(text)


def fold_romaji(text: Column) -> Column:
    """Fold spelling variants of romaji and English onto one form."""
    out = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    # (pattern, replacement) in order of application (fixed values).
    for pattern, to in (
        ("ou", "o"),
        ("oh(?=[b-df-hj-np-tv-z])", "o"),
        (r"([aiueo])\1+", "$1"),
        ("n(?=[bmp])", "m"),
        ("l", "r"),
        ("v", "b"),
        ("c(?=[eiy])", "s"),
        ("ck", "k"),
        ("[cq]", "k"),
        ("x", "ks"),
        ("sh", "s"),
        ("ch|ts", "t"),
        ("j", "z"),
        ("ph", "f"),
        ("wh", "w"),
        (r"([bcdfghjkmprstwyz])\1+", "$1"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return out


def romanize(text: Column) -> Column:
    return fold_romaji(katakana_to_romaji(text))


def consonant_skeleton(romaji: Column) -> Column:
    return F.translate(romaji, _VOWELS, "")


def _lexicon_index(lexicon) -> dict[str, str]:
    """Spelling -> canonical, longest spelling first; the earlier entry wins."""
    forms: dict[str, str] = {}
    for canonical, spellings in lexicon:
        for form in spellings:
            forms.setdefault(form.lower(), canonical)
    usable = {f: c for f, c in forms.items() if len(f) >= 3 or not re.match("[A-Za-z]", f)}
    return dict(sorted(usable.items(), key=lambda kv: -len(kv[0])))


def tokens(normalized: Column, lexicon=None, noise=None) -> Column:
    """Canonical tokens of a surface form.

    One regular expression cuts the text into lexicon spellings (longest first)
    and the runs between them; the runs are romanized where they can be.
    """
    index = _lexicon_index(lexicon or vocab.LEXICON)
    known = "|".join(re.escape(f) for f in index)
    pieces = F.regexp_extract_all(
        normalized, F.lit(f"((?:{known})|(?:(?!{known})[\\s\\S])+)"), 1
    )
    table = literal_map(index)

    def to_token(piece: Column) -> Column:
        # the first that isn't empty, so that a piece is romanized once
        read = F.try_element_at(F.filter(F.array(romanize(piece), piece), lambda r: r != ""), F.lit(1))
        return F.coalesce(F.try_element_at(table, piece), read)

    dropped = vocab.NOISE_TOKENS if noise is None else noise
    return F.filter(
        F.transform(pieces, to_token), lambda t: (t != "") & ~t.isin(list(dropped) or [""])
    )


def name_features(name: Column, lexicon=None) -> Column:
    """P6-P8 together: struct(normalized, tokens, canonical, skeleton).

    For a whole table, :func:`with_name` computes the same in steps.
    """
    normalized = normalize_name(name)
    return _features(normalized, tokens(normalized, lexicon), romanize(normalized))


def _features(normalized: Column, toks: Column, whole: Column) -> Column:
    canonical = F.array_join(toks, "")
    return F.struct(
        normalized.alias("normalized"),
        toks.alias("tokens"),
        canonical.alias("canonical"),
        consonant_skeleton(F.when(whole != "", whole).otherwise(canonical)).alias("skeleton"),
    )


def with_name(df: DataFrame, name: str = "building_name", out: str = "name", lexicon=None) -> DataFrame:
    """P6-P8 as a column of ``df``; steps keep each intermediate value computed once."""
    normalized = F.col("_name_normalized")
    return (
        df.withColumn("_name_normalized", normalize_name(F.col(name)))
        .withColumns({"_name_tokens": tokens(normalized, lexicon), "_name_whole": romanize(normalized)})
        .withColumn(out, _features(normalized, F.col("_name_tokens"), F.col("_name_whole")))
        .drop("_name_normalized", "_name_tokens", "_name_whole")
    )


def is_unnamed(name: Column) -> Column:
    """NULL, blank, or the unknown-name sentinel (never the blank-name one)."""
    return trim_space(F.coalesce(name, F.lit(""))).isin("", vocab.UNKNOWN_NAME)


def stored_name_key(name: Column, source_ref: Column) -> Column:
    """The stored comparison key; an unnamed row is told apart by its source id."""
    normalized = normalize_name(name)
    keyed = F.concat(normalized, F.lit("#"), source_ref)
    has_ref = F.coalesce(source_ref, F.lit("")) != ""
    return F.when((name == vocab.UNKNOWN_NAME) & has_ref, keyed).otherwise(normalized)
