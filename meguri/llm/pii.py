"""Personal data: proposed spans, scored by boosted trees.

Base spans follow fixed patterns and always stay. Beyond them, loose generators
propose overlapping spans: disguised mail addresses, numbers with other
separators or without a prefix, addresses of machines in other spellings. Trees
see the span's format and the text around it, and each kind has the threshold
at which held-out precision is high enough.

There are no hand-labelled spans. The trees learn from base spans of a bounded
sample (yes), disguised copies of these put in the same place (yes), and
whatever else the generators propose there, beside decoys of the same shapes in
places without base spans (no).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.boosting import Calibrated, Trees
from meguri.llm.common import batches, sampled, table, texts_of
from meguri.llm.registry import query
from meguri.llm.spans import SPANS, base_count, base_digest, digest, redacted

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches, found from each @: a search from every letter of a
    long run would read that run again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- generators ---------------------------------------------------------------
# Every repeat is bounded or possessive, so a scan is linear in the text.
_LOOSE = {
    "ip": [
        re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?\.\x20|\[\.\]|\(dot\))[0-9]{1,3}){3}(?![0-9])"),
        re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    ],
    "card": [re.compile(r"(?<![0-9])[0-9]{3,6}(?:[./_][0-9]{3,6}){2,4}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9+])\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
        re.compile(r"(?<![0-9+.-])[0-9]{2,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
        re.compile(r"(?<![0-9])00[0-9]{1,3}[\x20().0-9-]{6,16}[0-9]"),
    ],
}
# (text every match holds, pattern)
_MARKS = [
    (" at ", re.compile(r"\x20at\x20")), (" @", re.compile(r"\x20@\x20?")),
    ("(", re.compile(r"\(at\)\x20?", re.I | re.A)), ("[", re.compile(r"\[at\]\x20?", re.I | re.A)),
]
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20\.\x20|\.|\x20?[(\[][Dd][Oo][Tt][)\]]\x20?|\x20[Dd][Oo][Tt]\x20)[A-Za-z0-9-]{1,63}){1,4}")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """What the loose generators find, overlaps included, as distinct spans."""
    found: set[tuple[str, int, int]] = set()
    for sign, mark in _MARKS:
        for m in mark.finditer(text) if sign in text else ():
            host = _HOST.match(text, m.end())
            start = stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
            while host and start > max(0, stop - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if start < stop:
                found.add(("email", start, host.end()))
    if _DIGIT.search(text) or ":" in text:
        for kind, patterns in _LOOSE.items():
            found.update((kind, m.start(), m.end()) for p in patterns for m in p.finditer(text))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- features -----------------------------------------------------------------
# Words that announce personal data.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "account", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
AROUND = 40


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings, as numbers."""
    span = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    words = re.findall(r"[^\W\d_]+", (before + " " + after).lower())
    cues = CUES[kind]
    edge = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    around = before + after
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)),
        float(min(groups, default=0)), float(len(set(groups))), float(span.count(" ")), float(span.count(".")), float(span.count("-")),
        float(span.count("/") + span.count("_")), float("(" in span), float("[" in span), float("@" in span), float("+" in span),
        float(sum(c.isalpha() for c in span)), float(len(set(digits))), float(12 <= len(digits) <= 19 and luhn(digits)),
        float(bool(digits) and all(len(g) < 4 and int(g) < 256 for g in re.findall(r"[0-9]+", span[:64]))),
        float(bool(re.search(r"(?i)\b(?:com|net|org|edu|gov|io|de|fr|es|jp|uk)\W*$", span))), float(sum(w in cues for w in words)),
        edge(before[-1:]), edge(after[:1]), sum(c.isdigit() for c in around) / max(1, len(around)),
        sum(not (c.isalnum() or c.isspace()) for c in around) / max(1, len(around)), float(len(words)),
    ]


# -- weak labels --------------------------------------------------------------
def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def disguises(kind: str, span: str, rng: random.Random) -> list[str]:
    """Other spellings of the same personal data."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == "email":
        name, _, host = span.partition("@")
        if rng.random() < 0.5:  # names and hosts without digits too
            name, host = re.sub(r"[0-9]+", "", name).strip("._-") or "info", re.sub(r"[0-9]+", "", host)
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} @ {host}"]
    if kind == "ip":
        parts = span.split(".")
        return [" . ".join(parts), "[.]".join(parts), "(dot)".join(parts)]
    if kind == "card":
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [rng.choice("./_").join(four)] if min(map(len, four)) >= 3 else []
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:8]} {digits[8:]}"] if len(local) == 10 else []


def decoys(kind: str, rng: random.Random) -> list[str]:
    """Shapes that the generators propose and that are nobody's data."""
    if kind == "email":
        word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7)))
        return [f"{word()} at {word()} . {word()}", f"{word()}{_digits(rng, 1)} at {word()}{_digits(rng, 1)}.{_digits(rng, 2)}", f"{word()} at {word()}.{word().title()}", f"{word()} @ {_digits(rng, 1)}.{_digits(rng, 1)}"]
    if kind == "ip":
        return [f"{rng.randint(300, 999)}. {rng.randint(300, 999)}. {rng.randint(300, 999)}. {rng.randint(300, 999)}", "1. 2. 3. 4"]
    if kind == "card":
        bad = _digits(rng, 16)
        bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
        return [bad, f"{_digits(rng, 4)}/{_digits(rng, 4)}/{_digits(rng, 4)}"]
    return [f"{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 3)}", f"{_digits(rng, 2)}.{_digits(rng, 3)}.{_digits(rng, 3)}"]


def examples(texts: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind, text index) of weakly labelled spans."""
    rng = random.Random(seed)
    x, y, kinds, owner = [], [], [], []

    def put(text: str, kind: str, start: int, end: int, label: int, i: int) -> None:
        x.append(features(text, kind, start, end))
        y.append(label)
        kinds.append(kind)
        owner.append(i)

    def put_in_place(text: str, kind: str, start: int, end: int, other: str, label: int, i: int) -> None:
        changed = text[max(0, start - 200) : start] + other + text[end : end + 200]
        at = min(start, 200)
        for k, s, e in proposals(changed):
            if k == kind and s <= at and e >= at + len(other):
                put(changed, k, s, e, label, i)

    for i, text in enumerate(texts):
        base = base_spans(text)
        for kind, s, e in base:
            put(text, kind, s, e, 1, i)
            for other in disguises(kind, text[s:e], rng):
                put_in_place(text, kind, s, e, other, 1, i)
            for other in decoys(kind, rng):
                put_in_place(text, kind, s, e, other, 0, i)
        for kind, s, e in proposals(text):
            if not any(a < e and s < b for _, a, b in base):
                put(text, kind, s, e, 0, i)
    return np.array(x, dtype=float).reshape(len(y), -1), np.array(y), np.array(kinds), np.array(owner)


def fit(spark: SparkSession, docs: DataFrame, max_texts: int = 8000, max_chars: int = 20_000, precision: float = 0.98) -> Calibrated:
    """Trees and thresholds from at most ``max_texts`` texts, picked by a hash of
    the id among those of at most ``max_chars`` characters.

    Only the fit is bounded; scoring reads every text whole. No personal data in
    the sample: a model that adds nothing.
    """
    short = docs.select("doc_id", "text").filter(F.length("text") <= max_chars)
    rows = sampled(short, max_texts, "doc_id").filter(F.col("text").rlike("[0-9]|@")).select("text").collect()
    x, y, kind, owner = examples(sorted(r["text"] for r in rows))
    model = Calibrated(Trees(), precision)
    return model.fit(x, y, kind, owner % 3 == 2) if len(y) else model


def spans_of(text: str, model: Calibrated) -> list[dict]:
    """Base spans, and proposals beside them that the model accepts."""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for k, s, e in base]
    more = [c for c in proposals(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
    if more:
        scores = model.score(np.array([features(text, *c) for c in more]))
        kept: list[tuple[str, int, int]] = []
        for i in sorted(range(len(more)), key=lambda i: (-scores[i], more[i][1], more[i][2])):
            kind, s, e = more[i]
            if scores[i] >= model.cut.get(kind, np.inf) and not any(a < e and s < b for _, a, b in kept):
                kept.append(more[i])
                out.append({"kind": kind, "start": s, "end": e, "base": False, "score": float(scores[i])})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def find(docs: DataFrame, model: Calibrated) -> DataFrame:
    """doc_id and all spans of each text, one row per row of ``docs``.

    Null or empty text: no spans. Rows are judged one by one, so repeated rows,
    null ids and the order of rows change nothing; other columns are not read.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches(frames):
            found = [spans_of(t, model) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, model: Calibrated) -> DataFrame:
    """doc_id and text, every span replaced by its kind in brackets; null stays null."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            out = [None if t is None else redacted(t, [(s["kind"], s["start"], s["end"]) for s in spans_of(t, model)]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


@query("op3_pii_spans")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find(docs, fit(spark, docs))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[base_count(spans, k).alias(f"n_{k}") for k in KINDS], base_digest(spans).alias("base_sha256"),
        digest(spans).alias("spans"), F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
