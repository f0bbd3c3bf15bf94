"""Text spans shared by the scanning operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans of one text: code points, end exclusive; base ones follow fixed patterns.
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def base_digest(spans: Column) -> Column:
    return F.sha2(digest(F.filter(spans, lambda s: s["base"])).cast("binary"), 256)


def base_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or union of overlapping ones, as [kind]."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
