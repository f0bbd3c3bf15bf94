"""Alignment of two tokenizers' encodings of the same texts.

A is byte-level BPE, B is a piece model with byte fallback. Both encode the text
behind one space. Tokens and bytes make an incidence matrix for each tokenizer, in
compressed rows; the product A Bt holds the bytes that each A token shares with each B
token (overlap links). Bytes after which tokens of both end cut the tokens into
groups; the product of the incidences with the groups links all tokens of a group.
Overlap links whose tokens end together are the end links: their shorter token is a
suffix of the longer one, which bounds the different id pairs by the bytes of both
vocabularies, whatever the corpus.

Texts are read once; what the second pass needs, the end links as numbers of id pairs, is written.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm.common import batches, step, table
from meguri.llm.csr import Csr, product, ranges, spread, transposed
from meguri.llm.registry import query

TOKENIZERS = "/opt/tokenizers"  # the same folder on every machine
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WINDOW = 1 << 20  # bytes of text to a matrix, cut between groups
LINKS = 1 << 22  # links of groups to a matrix, cut between tokens of A
#: A unit runs to the next blank behind a character that is not white. No token of either crosses that place.
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
CALL = 4096  # units to a call of the piece model
#: Fixed value: how the byte-level tokenizer cuts a text into words.
WORDS_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin characters for themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of every id, and the id pairs that can end together."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{FILE_A}", encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [ranks[bytes(byte_of[c] for c in a + b)] for a, b in merged]
        if made != sorted(made):
            raise ValueError(f"{FILE_A}: ids do not follow the merges")
        self._a = tiktoken.Encoding("a", pat_str=WORDS_A, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.bytes_a[i] = data
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{FILE_B}: a piece goes on behind a blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        self.pairs = self._pairs(ranks)

    def _pairs(self, ranks: dict[bytes, int]) -> np.ndarray:
        """Sorted A id * vocabulary of B + B id, of ids one of which is a suffix of the other."""
        of_b: dict[bytes, list[int]] = {}
        for i, data in enumerate(self.bytes_b):
            of_b.setdefault(data, []).append(i)
        found = {(i, j) for data, i in ranks.items() for k in range(len(data)) for j in of_b.get(data[k:], ())}
        found |= {(ranks[data[k:]], j) for j, data in enumerate(self.bytes_b) for k in range(len(data)) if data[k:] in ranks}
        return np.array(sorted(i * len(self.bytes_b) + j for i, j in found), dtype=np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a whole text; none where the bytes of either differ from the text's behind a space."""
        a, b = self._a.encode_ordinary(" " + text), self._b.encode(text)
        data = b" " + text.encode("utf-8")
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return [], []
        return a, b

    def encode_units(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids of A and of B, ids of each unit of A and of B, whether a unit's bytes come back) of different units."""
        ids: list[list[int]] = [[], []]
        sizes = [np.zeros(len(units), dtype=np.int64) for _ in ids]
        for k in range(0, len(units), CALL):
            some = units[k : k + CALL]
            b = self._b.encode([u[1:] for u in some])  # the model puts the blank in front again
            ids[1] += [i for x in b for i in x]
            sizes[1][k : k + len(b)] = [len(x) for x in b]
        # one call: units end where the next one's blank begins, but those that end in a blank
        ends_white = [u[-1:].isspace() for u in units]
        whole = self._a.encode_ordinary("".join([u for u, white in zip(units, ends_white) if not white]))
        data = [u.encode("utf-8") for u in units]
        ends = np.cumsum([0 if white else len(d) for d, white in zip(data, ends_white)])
        at = np.searchsorted(np.cumsum(self.size_a[np.array(whole, dtype=np.int64)]), ends, side="right")
        last = 0
        for k, (stop, white) in enumerate(zip(at.tolist(), ends_white)):
            own = self._a.encode_ordinary(units[k]) if white else whole[last:stop]
            ids[0] += own
            sizes[0][k], last = len(own), stop
        arrays = [np.array(x, dtype=np.int64) for x in ids]
        good = np.ones(len(units), dtype=bool)
        for known, i, size in ((self.bytes_a, ids[0], sizes[0]), (self.bytes_b, ids[1], sizes[1])):
            stops = np.cumsum(size).tolist()
            good &= np.array([b"".join([known[x] for x in i[stop - n : stop]]) == d for d, n, stop in zip(data, size.tolist(), stops)], dtype=bool)
        return arrays, sizes, good

    @functools.cached_property
    def written(self) -> list[np.ndarray]:
        """Decimal ids of A with what follows them in a digest (, or |), then those of B (, or ;)."""
        tables = []
        for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")):
            tables.append(np.array([f"{i}{mark}".encode() for mark in (",", last) for i in range(n)], dtype=object))
        return tables


@functools.lru_cache(maxsize=2)
def vocabularies(folder: str) -> Vocabularies:
    return Vocabularies(folder)


class Aligned(NamedTuple):
    """Tokens of a batch of texts one after the other, and their groups."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray  # of each token, in bytes of the whole batch
    ends_b: np.ndarray
    cuts: np.ndarray  # where tokens of both end
    sizes_a: np.ndarray  # tokens of each text
    sizes_b: np.ndarray

    @property
    def groups_a(self) -> np.ndarray:
        return np.searchsorted(self.cuts, self.ends_a)

    @property
    def groups_b(self) -> np.ndarray:
        return np.searchsorted(self.cuts, self.ends_b)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's values, ``sizes`` of them each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def encoded(texts: list[str | None], vocab: Vocabularies) -> Aligned:
    """Both encodings of the texts. Each different unit of a batch is encoded once; texts
    with a unit whose bytes do not come back are encoded whole."""
    cut = [UNIT.findall(" " + t) if t else [] for t in texts]
    counts = np.array([len(x) for x in cut], dtype=np.int64)
    place: dict[str, int] = {}
    code = np.array([place.setdefault(u, len(place)) for x in cut for u in x], dtype=np.int64)
    arrays, sizes, good = vocab.encode_units(list(place))
    bad = np.flatnonzero(_sums(~good[code], counts))
    stand_in = {int(i): vocab.encode(texts[i]) for i in bad}
    owner = np.repeat(np.arange(len(texts)), counts)
    keep = ~np.isin(owner, bad)
    ids, per_text = [], []
    for k in (0, 1):
        size = np.where(keep, sizes[k][code], 0)
        starts = (np.cumsum(sizes[k]) - sizes[k])[code]
        own = arrays[k][spread(starts, size)]
        n = _sums(size, counts)
        if len(bad):
            parts = np.split(own, np.cumsum(n)[:-1])
            for i, both in stand_in.items():
                parts[i] = np.array(both[k], dtype=np.int64)
                n[i] = len(both[k])
            own = np.concatenate(parts)
        ids.append(own)
        per_text.append(n)
    ends_a, ends_b = np.cumsum(vocab.size_a[ids[0]]), np.cumsum(vocab.size_b[ids[1]])
    there = np.searchsorted(ends_b, ends_a)  # no token is empty, so ends ascend
    cuts = ends_a[(there < len(ends_b)) & (ends_b[np.minimum(there, len(ends_b) - 1)] == ends_a)] if len(ends_b) else ends_a[:0]
    return Aligned(*ids, ends_a, ends_b, cuts, *per_text)


def windows(found: Aligned) -> Iterator[tuple[slice, slice, int, int]]:
    """(A tokens, B tokens, first byte, byte after the last) of stretches of whole
    groups of about WINDOW bytes."""
    byte = 0
    while byte < (found.cuts[-1] if len(found.cuts) else 0):
        at = np.searchsorted(found.cuts, byte + WINDOW, side="right")
        last = int(found.cuts[max(at - 1, np.searchsorted(found.cuts, byte, side="right"))])
        part = [slice(*np.searchsorted(ends, [byte, last], side="right").tolist()) for ends in (found.ends_a, found.ends_b)]
        yield part[0], part[1], byte, last
        byte = last


def overlaps(found: Aligned, part: tuple[slice, slice, int, int]) -> Csr:
    """A Bt of a window: bytes that its A tokens (rows) share with its B tokens (columns)."""
    matrices = []
    for ends, of in ((found.ends_a, part[0]), (found.ends_b, part[1])):
        last = ends[of] - part[2]
        matrices.append(ranges(np.concatenate([[0], last[:-1]]), last, part[3] - part[2]))
    return product(matrices[0], transposed(matrices[1]))


def shared_groups(found: Aligned, part: tuple[slice, slice, int, int]) -> Iterator[tuple[slice, Csr]]:
    """Ga Gbt of a window: 1 for each A token (row) and B token (column) of one group.

    The links of a group are its A tokens times its B tokens, so the A tokens are taken in stretches (the
    first of the pair) of about LINKS links: what is held follows neither the group nor the window.
    """
    in_a, in_b = (np.searchsorted(found.cuts, ends[of]) for ends, of in ((found.ends_a, part[0]), (found.ends_b, part[1])))
    low, width = in_a[0], int(in_a[-1] - in_a[0]) + 1
    right = transposed(ranges(in_b - low, in_b - low + 1, width))
    through = np.cumsum(np.diff(right.starts)[in_a - low])
    row = 0
    while row < len(in_a):
        last = max(row + 1, int(np.searchsorted(through, (through[row - 1] if row else 0) + LINKS, side="right")))
        of = in_a[row:last] - low
        yield slice(part[0].start + row, part[0].start + last), product(ranges(of, of + 1, width), right)
        row = last


def group_links(found: Aligned) -> np.ndarray:
    """The number of group links of each A token."""
    counts = [np.diff(m.starts) for part in windows(found) for _, m in shared_groups(found, part)]
    return np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)


def end_links(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of the overlap links whose tokens end together, and the number of overlap links of each A token."""
    left, right, counts = [], [], []
    for part in windows(found):
        m = overlaps(found, part)
        a, b = m.rows + part[0].start, m.columns + part[1].start
        ends = found.ends_a[a] == found.ends_b[b]
        left.append(a[ends])
        right.append(b[ends])
        counts.append(np.diff(m.starts))
    whole = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right, counts)]
    return whole[0], whole[1], whole[2]


def digests(found: Aligned, vocab: Vocabularies, groups: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups written out; '' for a text without tokens.
    ``groups`` is the number of groups of each text."""
    in_a, in_b = found.groups_a, found.groups_b
    n = len(found.cuts)
    through_a, through_b = np.cumsum(np.bincount(in_a, minlength=n)), np.cumsum(np.bincount(in_b, minlength=n))
    before_b = np.concatenate([[0], through_b])
    items = np.empty(len(in_a) + len(in_b), dtype=object)
    for place, ids, of, written in (
        (np.arange(len(in_a)) + before_b[in_a], found.ids_a, in_a, vocab.written[0]),
        (np.arange(len(in_b)) + through_a[in_b], found.ids_b, in_b, vocab.written[1]),
    ):
        last = np.concatenate([of[1:] != of[:-1], np.ones(min(1, len(of)), dtype=bool)])
        items[place] = written[ids + last * (len(written) // 2)]
    out, at = [], 0
    for size in (found.sizes_a + found.sizes_b).tolist():
        out.append(hashlib.sha256(b"".join(items[at : at + size].tolist())[:-1]).hexdigest() if size else "")
        at += size
    return out


def _read(batch: pa.RecordBatch, vocab: Vocabularies) -> pa.RecordBatch:
    """The rows of ``read`` for a batch of (doc_id, text)."""
    found = encoded(batch.column(1).to_pylist(), vocab)
    a, b, counts = end_links(found)
    pair = np.searchsorted(vocab.pairs, found.ids_a[a] * len(vocab.bytes_b) + found.ids_b[b]).astype("<i4")
    links = _sums(np.bincount(a, minlength=len(found.ids_a)), found.sizes_a)
    text_bytes = _sums(vocab.size_a[found.ids_a], found.sizes_a)
    groups = np.diff(np.searchsorted(found.cuts, np.concatenate([[0], np.cumsum(text_bytes)]), side="right"))
    data, at = pair.tobytes(), np.concatenate([[0], np.cumsum(links)]) * 4
    return pa.RecordBatch.from_arrays([
        batch.column(0), pa.array(found.sizes_a), pa.array(found.sizes_b), pa.array(groups), pa.array(links),
        pa.array(_sums(counts, found.sizes_a)), pa.array(_sums(group_links(found), found.sizes_a)), pa.array(digests(found, vocab, groups)),
        pa.array([data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
    ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared", "groups_sha256", "links"])


def read(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_shared (links by overlap and by
    group), groups_sha256 and links (numbers of id pairs, 4 bytes each), a row per row of ``docs``.

    Null and empty texts, and texts whose tokens give other bytes than the text, have
    no tokens: zeros and an empty digest. Long texts are put into matrices by windows
    cut between groups. Repeated rows and null ids are rows like others; other columns
    are not read. No rows: no rows.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(folder)
        for batch in batches(frames):
            yield _read(batch, vocab)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups_sha256 string, links binary")


def pair_counts(done: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(pair, n): how many links of all rows of ``read`` hold each id pair. A task adds up its own first."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabularies(folder).pairs), dtype=np.int64)
        for batch in frames:
            for links in batch.column(0):
                np.add.at(total, np.frombuffer(links.as_buffer(), dtype="<i4"), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    return done.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The columns of ``read`` but links, with n_best (links whose pair counts as much as
    any of its B id) and count_sum (sum of the counts of a row's links).

    The counts are sent to every task: a number for each id pair that can end
    together, which the vocabularies bound (about 200,000 here), not the corpus.
    """
    spark = docs.sparkSession
    done = step(read(docs, folder), "aligned")
    counts = pair_counts(done, folder).toArrow()
    vocab = vocabularies(folder)
    known = np.zeros(len(vocab.pairs), dtype=np.int64)
    known[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    of_b = vocab.pairs % len(vocab.bytes_b)
    highest = np.zeros(len(vocab.bytes_b), dtype=np.int64)
    np.maximum.at(highest, of_b, known)
    sent = spark.sparkContext.broadcast((known, known == highest[of_b]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = sent.value
        for batch in frames:
            links = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in batch.column("links")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([int(best[x].sum()) for x in links], pa.int64()), pa.array([int(known[x].sum()) for x in links], pa.int64())],
                names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema if f.name != "links")
    return done.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def link_rows(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, kind (overlap or group), a and b (places of the tokens in their encodings), id_a, id_b,
    shared (bytes of an overlap) and ends (whether both tokens end together), a row per link.

    Texts as in ``read``; a row per link of one document, windows at a time.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(folder)
        for batch in batches(frames):
            found = encoded(batch.column(1).to_pylist(), vocab)
            text_a = np.repeat(np.arange(batch.num_rows), found.sizes_a)
            first = [np.cumsum(s) - s for s in (found.sizes_a, found.sizes_b)]
            for part in windows(found):
                for kind, of, m in itertools.chain([("overlap", part[0], overlaps(found, part))], (("group", *x) for x in shared_groups(found, part))):
                    a, b = m.rows + of.start, m.columns + part[1].start
                    row = text_a[a]
                    yield from batches([pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row)), pa.array([kind] * len(a)), pa.array(a - first[0][row]), pa.array(b - first[1][row]),
                        pa.array(found.ids_a[a]), pa.array(found.ids_b[b]), pa.array(m.values if kind == "overlap" else np.zeros_like(m.values)),
                        pa.array(found.ends_a[a] == found.ends_b[b]),
                    ], names=["doc_id", "kind", "a", "b", "id_a", "id_b", "shared", "ends"])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, kind string, a long, b long, id_a long, id_b long, shared long, ends boolean")


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")
