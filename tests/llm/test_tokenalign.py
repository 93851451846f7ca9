"""Token alignment, held against tokenizers run on whole texts and links found by comparing all ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import tokenalign

TEXTS = [
    "The tokens of two vocabularies rarely agree.\nSome do, though: unbelievably so.", "The tokens of a few, again and again",
    "", None, " ", "a  b\n\n c", "▁x", "日本語 テキスト 日本語", "x" * 300, "a b  ", "  a", "\ta \n b", "<s> </s> <|endoftext|> don't <0x41>",
    "é ﬁ Ａ１ 　x y\x1c z  w", "🙂 🙂🙂", "The tokens of a few, again and again", " ".join(f"w{i}" for i in range(900)), "a b \n",
]


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers
    import sentencepiece
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for k, b in enumerate(plain + [b for b in range(256) if b not in plain]):
        byte_of[chr(b) if k < len(plain) else chr(256 + k - len(plain))] = b

    def a(text):
        ids = whole.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte_of[c] for c in whole.id_to_token(i)) for i in ids]

    def b(text):
        ids = pieces.encode(text)
        return ids, [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return a, b


def plain(text, tokenizers_):
    """(ids of A, ids of B, groups, links as id pairs), or nothing."""
    if not text:
        return None
    (x, xb), (y, yb) = (t(text) for t in tokenizers_)
    wanted = b" " + text.encode()
    if b"".join(xb) != wanted or b"".join(yb) != wanted:
        return None
    ends = [np.cumsum([len(t) for t in bs]).tolist() for bs in (xb, yb)]
    spans = [list(zip([0, *e], e, strict=False)) for e in ends]
    links = [(x[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    groups, low = [], 0
    for high in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if low < e <= high) for ids, es in ((x, ends[0]), (y, ends[1]))))
        low = high
    return x, y, groups, links


def test_alignment_equals_whole_texts(docs, tokenizers_):
    rows = docs(*enumerate(TEXTS))
    found = {r.doc_id: r for r in tokenalign.alignment(rows).collect()}
    plain_ = [plain(t, tokenizers_) for t in TEXTS]
    count = Counter(p for x in plain_ if x for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    assert len(found) == len(TEXTS)
    assert sum(x is not None for x in plain_) > 10
    for i, x in enumerate(plain_):
        r = found[i]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        if x is None:
            assert got == (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = x
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best = sum(count[p] == most[p[0]] for p in links)
        assert got == (len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), sha), TEXTS[i]


def test_counts_without_broadcast_nulls_repeats_and_empty(docs, monkeypatch):
    rows = docs((1, "one two"), (1, "one two"), (None, "one two"), (3, None))
    expected = sorted(map(str, tokenalign.alignment(rows).collect()))
    assert len(expected) == 4
    assert len(set(expected)) == 3
    monkeypatch.setattr(tokenalign, "BROADCAST_PAIRS", 0)
    assert sorted(map(str, tokenalign.alignment(rows).collect())) == expected
    assert tokenalign.alignment(rows.where(F.lit(False))).count() == 0


def test_long_text_in_spans(monkeypatch):
    text = "some words,  and\nmore of them " * 40
    a, b = tokenalign.byte_level()(), tokenalign.pieces()()
    ids = pa.array([1, 2, 3])
    texts = [text, text, "other"]
    one = tokenalign._block(ids, texts, tokenalign._Stretches(a, b), pa.int32())
    monkeypatch.setattr(tokenalign, "SPAN", 50)
    monkeypatch.setattr(tokenalign, "REMEMBERED", 3)
    assert tokenalign._block(ids, texts, tokenalign._Stretches(a, b), pa.int32()).equals(one)


def test_product_equals_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        left, right = rng.integers(0, 2, (5, 7)) * rng.integers(1, 4, (5, 7)), rng.integers(0, 2, (7, 4))

        def csr(m):
            return tokenalign.Csr(np.r_[0, np.cumsum((m != 0).sum(1))], np.nonzero(m)[1], m[m != 0], m.shape[1])

        got, dense = csr(left).times(csr(right)), np.zeros((5, 4), int)
        dense[got.pairs()] = got.values
        assert (dense == left @ right).all()
        turned, back = csr(right).transposed(), np.zeros((4, 7), int)
        back[turned.pairs()] = turned.values
        assert (back == right.T).all()


def test_links_by_overlap_and_by_group():
    """Two tokenizers of letters: A cuts ` abcd` after b, B after c, so that all of it is one group."""
    a = tokenalign.Tokenizer(lambda t: [0, 1], [b" ab", b"cd"])
    b = tokenalign.Tokenizer(lambda t: [0, 1], [b" abc", b"d"])
    assert tokenalign.links_of_texts(["abcd"], a, b) == [{"overlap": [(0, 0), (1, 0), (1, 1)], "group": [(0, 0), (0, 1), (1, 0), (1, 1)]}]
    assert tokenalign.links_of_texts(["other"], a, b) == [{"overlap": [], "group": []}]
