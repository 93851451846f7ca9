"""Secret scanning: Aho-Corasick keywords first, anchored patterns near hits only, then checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of span in the order in which ties are listed. The base kinds come first.
KINDS = ("assign", "access", "hex", "github", "npm")
#: Keywords (in lower case, matched in either case) and keywords that are matched as they are.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
ACCESS_WORD, NPM_WORD = "AKIA", "npm_"
#: The least lengths of a base span, or of its value.
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LENGTH},}}")
_TAGGED = {"github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})"), "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})")}
_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

Span = tuple[str, int, int]


def _keywords() -> ahocorasick.Automaton:
    """All keywords in lower case, each with its kind and length."""
    automaton = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("github", GITHUB_WORDS), ("npm", (NPM_WORD,))):
        for word in words:
            automaton.add_word(word.lower(), (kind, len(word)))
    automaton.make_automaton()
    return automaton


def checksum_holds(body: str, check: str) -> bool:
    """Whether check is the CRC-32 of body in six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == check


def find_spans(text: str, keywords: ahocorasick.Automaton) -> list[Span]:
    """(kind, start, end) in code points, by start, then kind.

    Of each base kind, leftmost matches that do not overlap are taken first, and short ones dropped after.
    """
    spans: list[Span] = []
    lower = text.lower() if text.isascii() else text.translate(_LOWER)
    hits = sorted({(at - size + 1, kind) for at, (kind, size) in keywords.iter(lower)})
    over = {"assign": 0, "access": 0}
    for start, kind in hits:
        if kind in _TAGGED:
            if (m := _TAGGED[kind].match(text, start)) and checksum_holds(m[1], m[2]):
                spans.append((kind, start, m.end()))
        elif start >= over[kind] and (m := (_ASSIGN if kind == "assign" else _ACCESS).match(text, start)):
            over[kind] = m.end()
            if len(m[2]) >= ASSIGN_VALUE if kind == "assign" else m.end() - start >= ACCESS_LENGTH:
                spans.append((kind, start, m.end()))
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = _keywords()
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [
            [dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(text or "", keywords)]
            for text in batch["text"].to_pylist()
        ]
        yield pa.RecordBatch.from_pydict({"id": batch["id"], "spans": pa.array(found, schema)})


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for each row of docs; ends are exclusive, in code points.

    An automaton of keywords runs over each whole text; the patterns of `assign`, `access` and of tagged tokens
    are tried only where a keyword begins. Hex runs have no keyword, and are found by their own pattern. Tokens
    of the kinds `github` and `npm` count only if the CRC-32 in their last six characters holds.

    Null and empty texts have no spans. Null and repeated ids are rows like any other; the id's type is kept.
    Empty table: no rows. Other columns are ignored. No shuffle: each row is scanned where it is read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scanned, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, in its own columns, with every span replaced by `mask`; overlapping spans become one. Null stays null."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = _keywords()
        for batch in batches:
            texts = []
            for text in batch.column(text_col).to_pylist():
                out, last = [], 0
                for _, start, end in find_spans(text or "", keywords):
                    if start >= last:
                        out += [text[last:start], mask]
                    last = max(last, end)
                texts.append(None if text is None else "".join(out) + text[last:])
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(masked, docs.schema)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row: spans as text, base spans as a digest."""
    found = secret_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS[:3])
    return found.select(
        id_col, *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
