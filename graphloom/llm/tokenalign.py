"""Alignment of two tokenizers' tokens on the bytes of a text, by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Characters of text whose links are worked on at once.
SPAN = 500_000
#: Stretches between single spaces that a task remembers; links of eight times as many.
REMEMBERED = 300_000
#: Stretches that are encoded in one call.
JOINED = 256
#: Most id pairs whose counts are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 500_000

#: Where a text may be cut so that neither tokenizer has a token across: a single space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")


@dataclass
class Csr:
    """A sparse matrix by rows: columns[starts[i]:starts[i + 1]] are those of row i, with values beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_ranges(cls, ends: np.ndarray, width: int) -> Csr:
        """Row i has ones from where row i - 1 ends to ends[i]."""
        return cls(np.concatenate(([0], ends)), np.arange(width), np.ones(width, np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        by_column = np.argsort(self.columns, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(starts, rows[by_column], self.values[by_column], len(self.starts) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of the rows of other that row i names, each times its value."""
        lengths = np.diff(other.starts)[self.columns]
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(other.starts[self.columns] - first, lengths)
        values = np.repeat(self.values, lengths) * other.values[at]
        rows = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), lengths)
        cells = rows * other.width + other.columns[at]
        if len(cells) and (np.diff(cells) < 0).any():
            order = np.argsort(cells, kind="stable")
            cells, values = cells[order], values[order]
        new = np.flatnonzero(np.diff(cells, prepend=-1))
        sums = np.add.reduceat(values, new) if len(new) else values
        rows, columns = np.divmod(cells[new], other.width or 1)
        starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(self.starts) - 1))))
        return Csr(starts, columns, sums, other.width)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.columns


@dataclass
class Tokenizer:
    """encode(text): the ids of the text with a space before it; token_bytes: the bytes of each id."""

    encode: Callable[[str], list[int]]
    token_bytes: list[bytes]

    def __post_init__(self):
        self.lengths = np.array(list(map(len, self.token_bytes)), np.int64)

    def tokens(self, texts: Sequence[str], wanted: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has; none for a text that does not come back as wanted."""
        ids, sizes = [], []
        for at in range(0, len(texts), JOINED):
            some = range(at, min(at + JOINED, len(texts)))
            joined = " ".join([texts[k] for k in some])
            # Joined at single spaces, where no token lies across, texts are encoded in one call.
            found = [] if _UNEVEN.search(joined) or not all(texts[k] for k in some) else self.encode(joined)
            if found and b"".join(map(self.token_bytes.__getitem__, found)) == b"".join([wanted[k] for k in some]):
                last = np.searchsorted(np.cumsum(self.lengths[found]), np.cumsum([len(wanted[k]) for k in some]))
                ids.append(found)
                sizes.append(np.diff(last, prepend=-1))
                continue
            for k in some:
                found = self.encode(texts[k])
                if b"".join(map(self.token_bytes.__getitem__, found)) != wanted[k]:
                    found = []
                ids.append(found)
                sizes.append([len(found)])
        return np.array(list(chain.from_iterable(ids)), np.int64), np.concatenate(sizes).astype(np.int64)


def byte_level(ranks_file: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json") -> Callable[[], Tokenizer]:
    """Byte-level BPE with the ids of `vocabulary`. The merges run by `ranks_file`, the same vocabulary as ranks."""

    def make() -> Tokenizer:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks_file)) as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            size = max(json.load(file)["model"]["vocab"].values()) + 1
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        token_bytes = [b""] * max(size, len(ranks))
        for token, rank in ranks.items():
            token_bytes[rank] = token
        return Tokenizer(lambda text: encode(f" {text}"), token_bytes)

    return make


def pieces(model: str = "piece_bpe_32k.model") -> Callable[[], Tokenizer]:
    """Pieces of a sentencepiece model with byte fallback, which puts the space before the text itself."""

    def make() -> Tokenizer:
        import public_tokenizers
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        token_bytes = [
            bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()
            for i in range(processor.get_piece_size())
            for piece in [processor.id_to_piece(i)]
        ]
        return Tokenizer(processor.encode, token_bytes)

    return make


@dataclass
class Aligned:
    """Texts' tokens and links, text after text. starts_*: where each text's tokens, links and groups begin (and the last ends)."""

    ok: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    starts_group: np.ndarray
    overlaps: Csr
    shared: Csr


def align(texts: Sequence[str], a: Tokenizer, b: Tokenizer) -> Aligned:
    """The tokens of each text, with a space before it, by both tokenizers, and their links.

    Tokens meet where their bytes overlap: A times B transposed, of the tokens' incidence with bytes. Bytes at which
    both have an end cut the tokens into groups; the product of their incidence with groups links all of a group.
    A text whose bytes a tokenizer does not give back is not ok, and has neither tokens nor links.
    """
    wanted = [b" " + t.encode(errors="replace") for t in texts]
    ids, sizes = zip(*(t.tokens(texts, wanted) for t in (a, b)), strict=True)
    ok = (sizes[0] > 0) & (sizes[1] > 0)
    if not ok.all():
        ids = [i[np.repeat(ok, n)] for i, n in zip(ids, sizes, strict=True)]
        sizes = [n * ok for n in sizes]
    ends = [np.cumsum(t.lengths[i]) for t, i in zip((a, b), ids, strict=True)]
    starts = [np.concatenate(([0], np.cumsum(n))) for n in sizes]
    width = int(ends[0][-1]) if len(ends[0]) else 0
    with_bytes = [Csr.of_ranges(e, width) for e in ends]
    common = np.intersect1d(*ends, assume_unique=True)
    group = [np.searchsorted(common, e) for e in ends]
    with_groups = [Csr(np.arange(len(g) + 1), g, np.ones(len(g), np.int64), len(common)) for g in group]
    text_ends = np.cumsum(np.array(list(map(len, wanted))) * ok)
    return Aligned(
        ok, *ids, *starts, *group, np.concatenate(([0], np.searchsorted(common, text_ends, "right"))),
        with_bytes[0].times(with_bytes[1].transposed()), with_groups[0].times(with_groups[1].transposed()),
    )


class _Stretches:
    """What is known of stretches of text between cuts: counts, groups as text, and links as id pairs with their numbers."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        #: Each id as text, with what follows it within its side of a group and at the end of it.
        self.words = [b"%d%b" % (i, sign) for t, end in ((a, b"|"), (b, b";")) for i in range(len(t.token_bytes)) for sign in (b",", end)]
        self.first_word = (0, 2 * len(a.token_bytes))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: ok, tokens of A and of B, groups, links, shared-group links of each stretch.
        self.counts = np.zeros((0, 6), np.int64)
        self.starts, self.pairs, self.many = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, stretches: set[str]) -> None:
        """Places for all the stretches, those not seen before after the others."""
        new = [s for s in stretches if s not in self.place]
        if not new:
            return
        x = align(new, self.a, self.b)
        rows, columns = x.overlaps.pairs()
        pairs = x.ids_a[rows] * len(self.b.token_bytes) + x.ids_b[columns]
        text_of = np.repeat(np.arange(len(new)), np.diff(x.starts_a))
        of = text_of[rows]
        doc, pair, many = _summed(of, pairs, np.ones(len(of), np.int64))
        links = np.bincount(of, minlength=len(new))
        shared = np.bincount(text_of[x.shared.pairs()[0]], minlength=len(new))
        counts = np.stack([x.ok, np.diff(x.starts_a), np.diff(x.starts_b), np.diff(x.starts_group), links, shared], 1)
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += self._written(x)
        self.counts = np.concatenate((self.counts, counts))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.bincount(doc, minlength=len(new)))))
        self.pairs, self.many = np.concatenate((self.pairs, pair)), np.concatenate((self.many, many))

    def _written(self, x: Aligned) -> list[bytes]:
        """Each text's groups, `a1,a2|b1;` one after another."""
        codes = []
        for k, (ids, group) in enumerate(((x.ids_a, x.group_a), (x.ids_b, x.group_b))):
            last = np.r_[np.diff(group) != 0, True][: len(group)]
            codes.append(self.first_word[k] + 2 * ids + last)
        order = np.argsort(np.concatenate((2 * x.group_a, 2 * x.group_b + 1)), kind="stable")
        words = list(map(self.words.__getitem__, np.concatenate(codes)[order].tolist()))
        at = (x.starts_a + x.starts_b).tolist()
        return [b"".join(words[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def forget(self) -> None:
        """Forgets all when there is much of it, so that memory does not grow with the text."""
        if len(self.place) > REMEMBERED or len(self.pairs) > 8 * REMEMBERED:
            self.clear()


def _stretches(text: str) -> list[str]:
    return (_CUT.split if _UNEVEN.search(text) else lambda t: t.split(" "))(text)


def _spans(text: str) -> Iterator[list[str]]:
    """The stretches of a text, those of about SPAN characters at a time."""
    at = 0
    while len(text) - at > SPAN:
        cut = _CUT.search(text, at + SPAN)
        if cut is None:
            break
        yield _stretches(text[at : cut.start()])
        at = cut.end()
    yield _stretches(text[at:] if at else text)


#: What a document has: counts, digest of its groups, and its links as id pairs with how often each occurs.
_DOC = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<{pair}>, many array<int>"


def _aligner(make_a: Callable[[], Tokenizer], make_b: Callable[[], Tokenizer], pair_type: pa.DataType):
    """Batches of (id, text) to id and _DOC."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = make_a(), make_b()
        known = _Stretches(a, b)
        for batch in batches:
            texts, at = batch["text"], 0
            while at < len(texts):
                block, size = [], 0
                while at + len(block) < len(texts) and (not block or size < SPAN):
                    block.append(texts[at + len(block)].as_py() or "")
                    size += len(block[-1])
                yield _block(batch["id"].slice(at, len(block)), block, known, pair_type)
                at += len(block)

    return documents


def _block(ids: pa.Array, texts: list[str], known: _Stretches, pair_type: pa.DataType) -> pa.RecordBatch:
    counts = np.zeros((len(texts), 6), np.int64)
    digests = [hashlib.sha256() if t else None for t in texts]
    doc, pair, many = [], [], []
    jobs, size = [], 0

    def flush() -> None:
        nonlocal size
        if not jobs:
            return
        every = list(chain.from_iterable(stretches for _, stretches in jobs))
        known.learn(set(every))
        places = np.array(list(map(known.place.__getitem__, every)), np.int64)
        rows = np.repeat([d for d, _ in jobs], [len(stretches) for _, stretches in jobs])
        np.add.at(counts, rows, known.counts[places] * [0, 1, 1, 1, 1, 1])
        np.add.at(counts[:, 0], rows, 1 - known.counts[places, 0])  # stretches that are not ok
        began = 0
        for d, stretches in jobs:
            text = b"".join(map(known.groups.__getitem__, places[began : began + len(stretches)].tolist()))
            digests[d].update((b";" if d in seen else b"") + text[:-1])
            seen.add(d)
            began += len(stretches)
        lengths = np.diff(known.starts)[places]
        at = np.arange(lengths.sum()) + np.repeat(known.starts[places] - (np.cumsum(lengths) - lengths), lengths)
        found = _summed(np.repeat(rows, lengths), known.pairs[at], known.many[at])
        for all_, new in zip((doc, pair, many), found, strict=True):
            all_.append(new)
        jobs.clear()
        size = 0
        known.forget()

    seen: set[int] = set()
    for d, text in enumerate(texts):
        for stretches in _spans(text) if text else ():
            jobs.append((d, stretches))
            size += sum(map(len, stretches))
            if size >= SPAN:
                flush()
    flush()
    empty = np.zeros(0, np.int64)
    doc, pair, many = _summed(*(np.concatenate(x) if x else empty for x in (doc, pair, many)))
    bad = counts[:, 0] > 0
    counts[bad] = 0
    kept = ~bad[doc]
    doc, pair, many = doc[kept], pair[kept], many[kept]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))), pa.int32())
    sha = [x.hexdigest() if x and not w else "" for x, w in zip(digests, bad.tolist(), strict=True)]
    columns = [
        ids, *(pa.array(counts[:, k]) for k in range(1, 6)), pa.array(sha, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(pair).cast(pair_type)), pa.ListArray.from_arrays(offsets, pa.array(many).cast(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "many"])


def _summed(doc: np.ndarray, pair: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of each document once, in order, with the sum of their numbers."""
    if not len(doc):
        return doc, pair, many
    order = np.lexsort((pair, doc)) if pair.max() >= 1 << 40 or doc.max() >= 1 << 22 else np.argsort(doc << 40 | pair, kind="stable")
    doc, pair, many = doc[order], pair[order], many[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(pair) != 0)])
    return doc[first], pair[first], np.add.reduceat(many, first)


def token_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: Callable[[], Tokenizer] | None = None,
    b: Callable[[], Tokenizer] | None = None,
    pair_type: str = "int",
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, many) for each row of docs.

    pairs: the document's linked id pairs, each once, as id_a * (size of B's vocabulary) + id_b; many: how often each
    is linked. pair_type: int where all pairs fit in 31 bits, as those of the public vocabularies do, else long.
    Texts are cut at single spaces, where no token of either tokenizer lies across; stretches seen before in a task are
    not tokenised again. Rows with null or empty texts, and texts that a tokenizer does not give back, have zeros and no
    pairs. Repeated rows stay rows of their own; an empty table gives none; further columns of docs do not matter.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_DOC.format(pair=pair_type)}"
    return rows.mapInArrow(_aligner(a or byte_level(), b or pieces(), {"int": pa.int32(), "long": pa.int64()}[pair_type]), schema)


def links_of_texts(texts: Sequence[str], a: Tokenizer, b: Tokenizer) -> list[dict[str, list[tuple[int, int]]]]:
    """For looking at a few texts: each one's links as (place in A, place in B), by overlap of bytes and by group."""
    x = align(texts, a, b)
    out = [{"overlap": [], "group": []} for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), np.diff(x.starts_a))
    for name, product in (("overlap", x.overlaps), ("group", x.shared)):
        for i, j in zip(*(p.tolist() for p in product.pairs()), strict=True):
            out[text_of[i]][name].append((i - int(x.starts_a[text_of[i]]), j - int(x.starts_b[text_of[i]])))
    return out


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id has more."""
    counts = written(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    id_a = F.floor(F.col("pair") / size_b)
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))
    return counts.withColumn("id_a", id_a).join(most, "id_a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_b: int = 32_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared) for each row of docs.

    Links and their counts over all documents as token_links and pair_counts have them: n_best counts the links whose
    pair is the most frequent of its A id (ties included), count_sum adds the counts of all links. The links of each
    document are written once; counts are combined in each task before they are shuffled, and so bounded by the two
    vocabularies. Nulls, empty texts, repeated rows, empty tables and further columns: as for token_links; ties of
    counts are all best.
    """
    links = written(token_links(docs, id_col, text_col)).withColumn("_row", F.monotonically_increasing_id())
    counts = written(pair_counts(links, size_b))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    each = links.select("_row", F.explode(F.arrays_zip("pairs", "many")).alias("x"))
    each = each.select("_row", F.col("x.pairs").alias("pair"), F.col("x.many").cast("long").alias("many"))

    def total(of: Column) -> Column:
        return F.sum(F.col("many") * of)

    sums = each.join(counts, "pair").groupBy("_row").agg(
        total(F.col("best").cast("long")).alias("n_best"), total(F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return links.join(sums, "_row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_shared",
    )
