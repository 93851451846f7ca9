"""Packing of tokenised documents into sequences by minimum bin slack over lengths."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import text_column, written

CAPACITY = 2048
END_ID = 1
#: Rows of one remaining length that are numbered in one group, on average; of more than its square, the root of their number.
GROUP_ROWS = 100
#: Most slots that are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_SLOTS = 500_000
_MEMO = 600_000
#: Makes a function from text to its ids as little-endian four-byte numbers.
Tokenizer = Callable[[], Callable[[str], bytes]]


class WordTokenizer:
    """Ids of a `tokenizers` BPE file with word ends, memoised by the words between white space.

    The file's normalizer and pattern never join characters across ASCII white space, so a text's ids are those
    of its words. New words of plain letters go to the same merges in another library, which is faster; others
    go to the tokenizer itself, and so do words with the text of a special token.
    """

    #: The file's own pattern for pieces, and characters whose normal form is their lower case, alone and together.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile(r"[\x21-\x7E\xA1-\xAC\xAE-įĲ-ž]+")
    WORD_END = "</w>"

    def __init__(self, path: str):
        import regex
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.pieces = regex.compile(self.PIECES).findall
        self.specials = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        to_byte = _byte_of_char()
        ranks = {}
        for token, id_ in self.whole.get_vocab(with_added_tokens=False).items():
            if token not in self.specials:
                word = token.removesuffix(self.WORD_END)
                ranks[bytes(to_byte[c] for c in word) + b"\xff" * (len(word) < len(token))] = id_
        # 0xFF, which UTF-8 never has, stands for the end of a word.
        ranks.setdefault(b"\xff", max(ranks.values()) + 1)
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words, self.parts = _Memo(self._word), _Memo(self._part)

    def _part(self, part: bytes) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.merge(part + b"\xff")])

    def _word(self, word: bytes) -> bytes:
        parts = self.parts
        if word.isalpha():  # ASCII letters
            return parts[word.lower()]
        if word[-1:] in b".," and word[:-1].isalpha():
            return parts[word[:-1].lower()] + parts[word[-1:]]
        text = word.decode(errors="replace")
        if self.PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            low = text.lower()
            if low.isalpha():
                return parts[low.encode()]
            if low[-1] in ".," and low[:-1].isalpha():
                return parts[low[:-1].encode()] + parts[low[-1:].encode()]
            return b"".join([parts[p.encode()] for p in self.pieces(low)])
        return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])

    def __call__(self, text: str) -> bytes:
        """The text's ids, each as four bytes, lowest first."""
        return b"".join(map(self.words.__getitem__, text.encode(errors="replace").split()))


class _Memo(dict):
    """What a function gives for a word, kept for the first _MEMO words."""

    def __init__(self, function: Callable[[bytes], bytes]):
        super().__init__()
        self.function = function

    def __missing__(self, word: bytes) -> bytes:
        value = self.function(word)
        if len(self) < _MEMO:
            self[word] = value
        return value


def _byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _pieces(tokenizer: Tokenizer, capacity: int, end_id: int | None):
    """Batches of (id, text) to the pieces of each document: full ones of `capacity`, and what remains."""
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer()
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = tokenize(text) + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows, pa.int32())), *numbers], ["id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return cut


def fill_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins for `counts` pieces of each length: (how many bins, pieces of each length in such a bin).

    Each bin takes the largest length left and, of the rest, the multiset whose sum leaves least slack: a
    bitset has the sums that can be reached, one shifted copy for each binary part of a length's count, and the
    best sum is traced back to counts. A bin is repeated as long as its pieces last, so the work depends on the
    number of distinct lengths, at most `capacity`, and not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        first = max(left)
        room = capacity - first
        steps: list[tuple[int, int, int]] = []  # length, pieces taken at once, sums reachable before
        sums, full = 1, (1 << (room + 1)) - 1
        for n in sorted((n for n in left if n <= room), reverse=True):
            most = min(left[n] - (n == first), room // n)
            part = 1
            while most > 0 and not sums >> room & 1:
                take = min(part, most)
                steps.append((n, take, sums))
                sums = (sums | sums << (n * take)) & full
                most -= take
                part *= 2
            if sums >> room & 1:
                break
        at, taken = sums.bit_length() - 1, {first: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                taken[n] = taken.get(n, 0) + take
                at -= n * take
        bins = min(left[n] // c for n, c in taken.items())
        plan.append((bins, taken))
        for n, c in taken.items():
            left[n] -= bins * c
            if not left[n]:
                del left[n]
    return plan


def pack(
    docs: DataFrame,
    tokenizer: Tokenizer,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int | None = END_ID,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    tokenizer: makes, in the worker, a function from text to ids as little-endian four-byte numbers. Every document's ids, with `end_id` behind,
    are cut into pieces of `capacity`, which are sequences of their own, and a remainder. The driver gets the
    number of remainders of each length (at most `capacity` numbers, however many rows) and plans the bins; a
    remainder finds its place by its rank among those of its length. Lengths of more than group_rows rows are ranked
    in groups by a hash, whose sizes are added up: of n rows of one length no task gets more than about the root of n,
    once as rows of a group and once as sizes of groups.

    Null and empty texts are the end id alone (without one: no row). Rows with null or repeated ids are packed
    like any others. Empty table: no rows. Other columns are ignored. sequence_id counts from 0, without gaps.
    """
    rows = docs.select(docs[id_col].alias("id"), text_column(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = written(
        rows.mapInArrow(
            _pieces(tokenizer, capacity, end_id),
            f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
        )
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = fill_plan(counts, capacity)
    spark = docs.sparkSession

    # For each length and kind of bin: the ranks [low, high) that go there, pieces a bin, first sequence, offset.
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, taken in plan:
        offset = 0
        for n, c in sorted(taken.items(), reverse=True):
            slots.append((n, used[n], used[n] + bins * c, c, sequence, offset))
            used[n] += bins * c
            offset += n * c
        sequence += bins
    slot = spark.createDataFrame(
        slots, "length bigint, low bigint, high bigint, each bigint, first_sequence bigint, first_offset bigint"
    )

    # capacity rows at most
    groups = spark.createDataFrame(
        [(n, -(-c // max(group_rows, math.isqrt(c)))) for n, c in counts.items()], "length bigint, groups bigint"
    )
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("groups")))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_group = Window.partitionBy("length", "group").orderBy("id", "start", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(in_group) - 1).join(sizes, ["length", "group"])
    ranked = ranked.withColumn("rank", F.col("at") + F.col("before"))
    # As a rule a few thousand: the plan has one kind of bin for each length or so.
    placed = ranked.join(F.broadcast(slot) if len(slots) <= BROADCAST_SLOTS else slot, "length").where("low <= rank AND rank < high")
    here = F.col("rank") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(here / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(here, F.col("each")) * F.col("length")).alias("offset"),
    )


def public_tokenizer(name: str = "word_bpe_49k.json") -> Callable[[], WordTokenizer]:
    """Makes the tokenizer of a public vocabulary file, wherever a worker has the package."""

    def make() -> WordTokenizer:
        import public_tokenizers

        return WordTokenizer(public_tokenizers.path(name))

    return make


def token_counter(name: str = "word_bpe_49k.json") -> Callable[[], Callable[[str], int]]:
    """Makes, in the worker, a function from a text to the number of its ids by public_tokenizer."""
    make = public_tokenizer(name)

    def counter() -> Callable[[str], int]:
        tokenize = make()
        return lambda text: len(tokenize(text)) // 4

    return counter


def byte_token_counter(name: str = "byte_bpe_50k.tiktoken") -> Callable[[], Callable[[str], int]]:
    """The same for a public file of byte-level ranks."""

    def counter() -> Callable[[str], int]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name)) as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))

    return counter
