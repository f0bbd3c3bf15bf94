"""Alignment of two tokenizers against plain loops over offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from meguri.llm import alignment
from meguri.llm.common import table
from meguri.llm.csr import Csr, product, transposed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.FILE_B}")


def plain_tokens(text, libraries):
    """(id, bytes) of both encodings, with the libraries that the files are of."""
    a, b = libraries
    if not text:
        return [], []
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in chars}
    for c in range(256):
        if c not in chars:
            byte[chr(256 + len(byte) - len(chars))] = c
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == data for side in (left, right)) else ([], [])


def plain_alignment(texts, libraries):
    tokens = [plain_tokens(t, libraries) for t in texts]
    ends = []
    for sides in tokens:
        ends.append([[], []])
        for side, out in zip(sides, ends[-1]):
            at = 0
            for _, data in side:
                at += len(data)
                out.append(at)
    links = [[(l[0][i][0], l[1][e[1].index(x)][0]) for i, x in enumerate(e[0]) if x in e[1]] for l, e in zip(tokens, ends)]
    count = Counter(p for x in links for p in x)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (left, right), (ea, eb), pairs in zip(tokens, ends, links):
        groups, i, j = [], 0, 0
        for cut in sorted({*ea} & {*eb}):
            ni, nj = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append((left[i:ni], right[j:nj]))
            i, j = ni, nj
        text = ";".join("|".join(",".join(str(x[0]) for x in side) for side in g) for g in groups)
        spans = [[(e - len(t[1]), e) for t, e in zip(s, es)] for s, es in ((left, ea), (right, eb))]
        rows.append((
            len(left), len(right), len(groups), len(pairs), sum(count[p] == highest[p[1]] for p in pairs), sum(count[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if left else "", sum(max(x[0], y[0]) < min(x[1], y[1]) for x in spans[0] for y in spans[1]),
            sum(len(x) * len(y) for x, y in groups),
        ))
    return rows


def check(spark, rows, libraries):
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, pair int").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared"]
    got = sorted(((r["doc_id"] is not None, r["doc_id"]), *[r[n] for n in names]) for r in alignment.align(docs).collect())
    want = sorted(((r[0] is not None, r[0]), *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows], libraries)))
    assert got == want


def test_odd_texts(spark, libraries):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "a", " a", "<|endoftext|> <s></s><unk><0x41>", "▁ ▁x", "日本語のとても長い一行", "😀😀a😀", "é" * 50, "\0a\x00", "\t\t  x  \n\n y ", "the the the"]
    texts += ["".join(rng.choice("abé日 ,😀\n1 the") for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts += ["word " * 4000, "x" * 3000]
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "a b", None, None), (3, "a b", None, None), (3, "a b", None, None)]
    check(spark, rows, libraries)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, libraries):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in alignment.op11(spark, FOLDER).collect()}
    tokens = {i: plain_tokens(t, libraries) for i, t in texts}  # by dictionaries of ends: whole texts are long
    links, count = {}, Counter()
    for i, sides in tokens.items():
        ends = [{}, {}]
        for side, at_end in zip(sides, ends):
            at = 0
            for k, (t, data) in enumerate(side):
                at += len(data)
                at_end[at] = (k, t)
        links[i] = [(ends[0][x], ends[1][x]) for x in sorted(ends[0].keys() & ends[1].keys())]
        count.update((a[1], b[1]) for a, b in links[i])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for i, sides in tokens.items():
        groups, at = [], (0, 0)
        for (k, _), (j, _) in links[i]:
            groups.append("|".join(",".join(str(t) for t, _ in s[x : y + 1]) for s, x, y in ((sides[0], at[0], k), (sides[1], at[1], j))))
            at = k + 1, j + 1
        ids = [(a[1], b[1]) for a, b in links[i]]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert got[i] == (len(sides[0]), len(sides[1]), len(groups), len(ids), sum(count[p] == best[p[1]] for p in ids), sum(count[p] for p in ids), digest)


def test_links_and_windows(spark, libraries, monkeypatch):
    texts = ["hello world of tokens", "日本語 the end", None, "naïve café 12345"]
    rows = {(r["doc_id"], r["kind"], r["a"], r["b"]): r for r in alignment.link_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = []
        for side in plain_tokens(text, libraries):
            ends = np.cumsum([len(d) for _, d in side]).tolist()
            spans.append([(e - len(d), e) for (_, d), e in zip(side, ends)])
        want = {(i, "overlap", k, j): min(x[1], y[1]) - max(x[0], y[0]) for k, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])}
        assert {k: r["shared"] for k, r in rows.items() if k[:2] == (i, "overlap")} == want
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        of = lambda e: next(n for n, c in enumerate(cuts) if e <= c)
        assert {k for k in rows if k[:2] == (i, "group")} == {(i, "group", k, j) for k, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if of(x[1]) == of(y[1])}
    vocab = alignment.vocabularies(alignment.TOKENIZERS)
    found = alignment.encoded(texts * 5, vocab)
    whole = alignment.end_links(found)
    monkeypatch.setattr(alignment, "WINDOW", 7)
    assert len(list(alignment.windows(found))) > 20
    assert all((x == y).all() for x, y in zip(whole, alignment.end_links(found)))


def test_group_links_by_products(monkeypatch):
    texts = ["hello world of tokens", "日本語 the end", None, "naïve café 12345", "# " + "#" * 3001, "", "0" * 500]
    vocab = alignment.vocabularies(alignment.TOKENIZERS)
    found = alignment.encoded(texts, vocab)
    n = len(found.cuts)
    want = np.bincount(found.groups_b, minlength=n)[found.groups_a]
    assert want.max() > 50  # a group of many tokens of both
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    sizes = []
    monkeypatch.setattr(alignment, "product", lambda x, y: sizes.append(len((m := product(x, y)).columns)) or m)
    for links, window in ((alignment.LINKS, alignment.WINDOW), (40, alignment.WINDOW), (1, 7)):
        monkeypatch.setattr(alignment, "LINKS", links)
        monkeypatch.setattr(alignment, "WINDOW", window)
        assert (alignment.group_links(found) == want).all()
        sizes.clear()
        rows = alignment._read(batch, vocab).to_pydict()
        # each link that is counted is an entry of a product
        assert sum(sizes) == sum(rows["n_overlaps"]) + sum(rows["n_shared"])
        assert rows["n_shared"] == alignment._sums(want, found.sizes_a).tolist()
    part = next(alignment.windows(found))
    monkeypatch.setattr(alignment, "LINKS", 40)
    assert all(len(m.columns) <= max(40, np.diff(m.starts)[0]) for _, m in alignment.shared_groups(found, part))


def test_products():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, k, m = rng.integers(1, 7, 3)
        x, y = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))
        sparse = lambda d: Csr(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]), np.nonzero(d)[1], d[d > 0], d.shape[1])
        dense = np.zeros((n, m), dtype=np.int64)
        p = product(sparse(x), sparse(y))
        dense[p.rows, p.columns] = p.values
        assert (dense == x @ y).all()
        t = transposed(sparse(x))
        dense = np.zeros((k, n), dtype=np.int64)
        dense[t.rows, t.columns] = t.values
        assert (dense == x.T).all()


def test_every_pair_is_known():
    vocab = alignment.vocabularies(alignment.TOKENIZERS)
    assert len(vocab.pairs) <= sum(map(len, vocab.bytes_a)) + 2 * sum(map(len, vocab.bytes_b))
