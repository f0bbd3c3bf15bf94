"""Quality rules: plain counts, and repetition found with a suffix array.

The suffix array runs over the words of a batch of whole texts at once. Its
intervals of common prefixes give each word position the longest sequence that
starts there and occurs again in the same text. The union of those of
``min_words`` or more is the repeated part of the text; too large a part or too
long a single repeat rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meguri.llm.common import batches, table, texts_of, word_codes
from meguri.llm.registry import query
from meguri.llm.suffixes import covered, longest_repeats

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_COLUMNS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat",
]
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, repeats array<struct<start:long,end:long>>"
)


def _lines_seen_before(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judged(texts: list[str], min_words: int, max_share: float, max_repeat: int) -> dict[str, list]:
    """The rule's columns for a list of texts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, codes, _ = word_codes([d.split() for d in data])
    sizes = np.diff(starts)
    long = longest_repeats(starts, codes, min(5, min_words))
    base = covered(np.where(long >= 5, 5, 0))
    spans = covered(np.where(long >= min_words, long, 0))
    # reduceat needs non-empty texts; the others stay 0
    some = np.flatnonzero(sizes)
    def per_text(values: np.ndarray, how) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        if len(some):
            out[some] = how.reduceat(values, starts[some])
        return out
    n_repeat, n_covered = per_text(base.astype(np.int64), np.add), per_text(spans.astype(np.int64), np.add)
    longest = per_text(np.where(long >= min_words, long, 0), np.maximum)
    owner_start = np.repeat(starts[:-1], sizes)
    first = spans & ~np.concatenate([[False], spans[:-1]]) | spans & (np.arange(len(spans)) == owner_start) if len(spans) else spans
    edges = np.flatnonzero(first)
    stops = np.flatnonzero(spans & np.concatenate([~spans[1:] | first[1:], [True]])) + 1 if len(spans) else edges
    owner = np.searchsorted(starts, edges, side="right") - 1
    repeats: list[list[dict]] = [[] for _ in texts]
    for i, s, e in zip(owner.tolist(), edges.tolist(), stops.tolist()):
        repeats[i].append({"start": s - int(starts[i]), "end": e - int(starts[i])})
    failed = (sizes < 10) | (100 * n_repeat > 20 * sizes)
    kept = ~failed & (n_covered <= max_share * sizes) & (longest <= max_repeat)
    return {
        "n_words": sizes, "word_chars": [len(t) - (len(d) - len(d.translate(None, _SPACE))) for t, d in zip(texts, data)],
        "n_symbols": [len(d) - len(d.translate(None, _SYMBOLS)) for d in data], "n_dup_lines": [_lines_seen_before(d) for d in data],
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "covered_words": n_covered, "longest_repeat": longest, "repeats": repeats,
    }


def judge(docs: DataFrame, min_words: int = 8, max_share: float = 0.2, max_repeat: int = 100) -> DataFrame:
    """doc_id, the counts, both verdicts and the repeated word spans of each
    text, one row per row of ``docs``.

    Null or empty text: no words, so it fails the base rules. Rows are judged
    one by one: repeated rows, null ids and their order change nothing; other
    columns are not read.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches(frames):
            found = judged(texts_of(batch.column(1)), min_words, max_share, max_repeat)
            arrays = [pa.array(v, spans) if k == "repeats" else pa.array(v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


@query("op8_quality_repetition")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents")).select("doc_id", *_COLUMNS)
