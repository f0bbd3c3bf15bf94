"""Secrets in plain and in encoded text.

Base spans follow fixed patterns over the text as it stands. A worklist then
unwraps layers: URL escapes, Unicode escapes and character references, base64,
and gzip, zlib or bzip2 within it. Every new layer is scanned and unwrapped in
turn until nothing new comes out; content that was seen before is not entered
again, so cycles end. Base64 may be wrapped over lines. Each character of a layer knows the stretch of the
original text that it came from, and so does each span found there.

Compressed data is read to its end, in windows that are cut only where no
pattern can lie across, and whatever else it holds: bytes that are no text
stand as replacement characters. One window is in memory for each layer of
depth; a window grows while it has no place for a cut. An escape nested more than
``LEVELS`` deep is unwrapped down to that depth at once, so the time for it
follows its length.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, table, texts_of
from meguri.llm.registry import query
from meguri.llm.spans import base_count, base_digest, digest, redacted

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- layers -------------------------------------------------------------------
class Layer:
    """A text, where each of its characters comes from, and how it was unwrapped."""

    __slots__ = ("text", "starts", "ends", "way")

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int], way: str):
        self.text, self.starts, self.ends, self.way = text, starts, ends, way

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if len(self.starts) == 1 < len(self.text):  # all of it from one stretch
            return self.starts[0], self.ends[0]
        return self.starts[start], self.ends[end - 1]


_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|&#x([0-9a-fA-F]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++={0,2}[\x20\t]*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2}[\x20\t]*(?=[\r\n]|\Z))+")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What may stand after an escaped sign for it to begin an escape again.
_NEXT = {
    "%": re.compile(r"()()()()()([0-9A-Fa-f]{2})"),
    "\\": re.compile(r"u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})"),
    "&": re.compile(r"()()()#x([0-9a-fA-F]{1,6});|#([0-9]{1,7});"),
}
#: Any secret, and any escape or base64 run that holds one, has as many printable characters in a row.
_PRINTABLE = re.compile(r"[\x20-\x7e]{16}")
#: Places that no secret, escape or encoded run lies across: a lone blank between
#: words, and the break before a line that is no base64.
_CUT = re.compile(r"(?<=[^\s:=])\x20(?=[^\s:=])|\n(?=[\x20\t]*\r?\n|[^\n]*[^A-Za-z0-9+/_=\s-])")
#: Escapes nested deeper are unwrapped down to this depth at once.
LEVELS = 8
#: Characters of a window of compressed text, and bytes that are decompressed at a time.
WINDOW, SLICE = 1 << 24, 1 << 20


def _url(run: re.Match) -> str:
    return bytes.fromhex(run.group().replace("%", "")).decode("utf-8", "replace")


def _unicode(run: re.Match) -> str:
    u, long, x, ref16, ref10 = run.groups()
    code = int(ref10) if ref10 else int(u or long or x or ref16, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _nested(text: str, sign: str, at: int) -> tuple[str, int]:
    """(sign, end) of an escape that stood for ``sign`` and ended at ``at``, where
    that sign begins escapes again: followed until ``LEVELS`` of them are left."""
    passed = [(sign, at)]
    while sign in _NEXT and (m := _NEXT[sign].match(text, at)):
        hit = next(g for g in reversed(m.groups()) if g)
        code = int(hit, 10 if sign == "&" and m.group(4) is None else 16)
        sign, at = chr(code) if code < 0x80 else "", m.end()
        passed.append((sign, at))
    return passed[max(0, len(passed) - 1 - LEVELS)]


def _spliced(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], str], way: str) -> Layer | None:
    """The layer with each match replaced by what it stands for."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    whole = len(layer.starts) == 1  # all of it from one stretch

    def keep(start: int, end: int) -> None:
        parts.append(text[start:end])
        if not whole:
            starts.extend(layer.starts[start:end])
            ends.extend(layer.ends[start:end])

    while m := pattern.search(text, at):
        keep(at, m.start())
        new, after = decode(m), m.end()
        if new[-1:] in _NEXT:
            sign, after = _nested(text, new[-1], after)
            new = new[:-1] + sign
        if not whole:
            per = (m.end() - m.start()) // len(new) if len(new) * 3 == m.end() - m.start() else 0
            for i in range(len(new)):  # one escape for each character, or the run as a whole
                s, e = layer.origin(m.start() + i * per, m.start() + (i + 1) * per) if per else layer.origin(m.start(), m.end())
                starts.append(s)
                ends.append(e)
            ends[-1] = layer.origin(after - 1, after)[1]
        parts.append(new)
        at = after
    if not at:
        return None
    keep(at, len(text))
    return Layer("".join(parts), *((layer.starts, layer.ends) if whole else (starts, ends)), f"{layer.way}{way}/")


def _member(data: bytes):
    """A decompressor for what ``data`` begins with; None if it isn't compressed."""
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    return None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of all members of compressed data, at most ``SLICE`` bytes at a
    time; it ends where something else follows, or the data is damaged."""
    rest, d = b"", None
    for chunk in chunks:
        rest += chunk
        while rest:
            if d is None:
                if len(rest) < 3:
                    break  # what a member begins with needs more
                if (d := _member(rest)) is None:
                    return
            try:
                new = d.decompress(rest, SLICE)
            except (OSError, EOFError, ValueError, zlib.error):
                return
            if isinstance(d, bz2.BZ2Decompressor):  # keeps what it has not read yet
                rest = b""
                while new and not d.eof and not d.needs_input:
                    yield new
                    try:
                        new = d.decompress(b"", SLICE)
                    except (OSError, EOFError, ValueError):
                        return
            else:
                rest = d.unconsumed_tail
            if new:
                yield new
            if d.eof:
                rest, d = d.unused_data, None


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of ``chunks`` in parts of about ``WINDOW`` characters that end at a ``_CUT``."""
    decoder, parts, size, enough = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, WINDOW
    for chunk in chunks:
        parts.append(decoder.decode(chunk))
        size += len(parts[-1])
        if size >= enough:
            text, last = "".join(parts), 0
            for start in (max(0, size - 65536), 0):  # the last place is mostly near the end
                for m in _CUT.finditer(text, start):
                    last = m.end()
                if last:
                    break
            if last:
                yield text[:last]
            parts, size = [text[last:]], size - last
            enough = max(WINDOW, 2 * size)
    yield "".join([*parts, decoder.decode(b"", True)])


def _contents(data: bytes, way: str) -> Iterator[tuple[str, str]]:
    """(text, way) of each window of ``data`` as it stands and, through every
    compression, of what is innermost. Data that unpacks to itself ends there."""
    yield from ((t, way) for t in _windows(iter([data])))
    chunks, passed, depth = iter([data]), set(), 0
    while True:
        head = next(chunks, b"")
        while len(head) < 64 and (more := next(chunks, b"")):
            head += more
        mark = hashlib.sha1(head).digest()
        if _member(head) is None or mark in passed:
            chunks = chain([head], chunks)
            break
        passed.add(mark)
        read = [head]

        def noted(chunks: Iterator[bytes] = chunks, read: list[bytes] = read) -> Iterator[bytes]:
            yield read[0]
            for chunk in chunks:
                if read[0]:
                    read.append(chunk)
                yield chunk

        inner = _inflated(noted())
        if not (first := next(inner, b"")):
            chunks = chain(read, chunks)  # it only looked like compressed data
            break
        read[:] = [b""]
        chunks, way, depth = chain([first], inner), f"{way}compressed/", depth + 1
    if depth:
        yield from ((t, way) for t in _windows(chunks))


def _unpacked(text: str) -> bytes | None:
    bare = text.rstrip("=")
    if len(bare) % 4 == 1:
        return None
    bare = bare.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of what may be base64: unbroken runs, and runs over
    several lines. Wrapped lines are of one length, but for the first, which may
    stand behind a word, and the last; either may also be no part of it."""
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m.group()
    if "\n" not in text:
        return
    for m in _LINES.finditer(text):
        lines = [(x.start(), x.end(), x.group()) for x in _LINE.finditer(text, m.start(), m.end())]
        first = 0
        while first < len(lines):
            last, width = first, len(lines[first][2])
            while last + 1 < len(lines) and len(lines[last + 1][2]) == width and not lines[last][2].endswith("="):
                last += 1
            if width >= 16:
                for a in {max(0, first - 1), first}:
                    for b in {last, min(last + 1, len(lines) - 1)}:
                        if a < b:
                            yield lines[a][0], lines[b][1], "".join(x[2] for x in lines[a : b + 1])
            first = last + 1


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly under one."""
    if "%" in layer.text and (new := _spliced(layer, _URL, _url, "url")):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _spliced(layer, _UNICODE, _unicode, "unicode")):
        yield new
    for first, last, encoded in _encoded(layer.text):
        if data := _unpacked(encoded):
            start, end = layer.origin(first, last)
            for text, way in _contents(data, f"{layer.way}base64/"):
                if _PRINTABLE.search(text):
                    yield Layer(text, [start], [end], way)


def spans_of(text: str) -> list[dict]:
    """All spans of a text: base ones, and those of every layer under it."""
    base = scan(text)
    out = [{"kind": k, "start": s, "end": e, "base": True, "way": ""} for k, s, e in base]
    found, seen = set(base), set()
    work = [iter([Layer(text, range(len(text)), range(1, len(text) + 1), "")])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = hashlib.sha1(layer.text.encode("utf-8", "surrogatepass") + repr(layer.origin(0, len(layer.text))).encode()).digest()
        if mark in seen:
            continue
        seen.add(mark)
        if layer.way:
            for kind, s, e in scan(layer.text):
                span = (kind, *layer.origin(s, e))
                if span not in found:
                    found.add(span)
                    out.append({"kind": kind, "start": span[1], "end": span[2], "base": False, "way": layer.way})
        work.append(_unwrapped(layer))
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


_FOUND = "spans array<struct<kind:string,start:long,end:long,base:boolean,way:string>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of each text with the layers they were under, one row per row of ``docs``.

    Null or empty text: no spans. Rows are judged one by one, so repeated rows,
    null ids and the order of rows change nothing; other columns are not read,
    whatever their names. No rows: no rows. Very long texts and layers are read whole.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("way", pa.string())]))
        for batch in batches(frames):
            found = [spans_of(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text, every span replaced by its kind in brackets; null stays null."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            out = [None if t is None else redacted(t, [(s["kind"], s["start"], s["end"]) for s in spans_of(t)]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


@query("op6_secret_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[base_count(spans, k).alias(f"n_{k}") for k in KINDS], base_digest(spans).alias("base_sha256"),
        digest(spans).alias("spans"), F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
