"""Benchmark decontamination with a broadcast hash set of normalised word windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, free_names, text_column, written

WINDOW = 13
#: Most benchmark windows that are broadcast whole (about 200 bytes each). A larger benchmark is probed by its bits.
BROADCAST_WINDOWS = 500_000
#: Bits for each window of a large benchmark, so that of windows elsewhere one in so many passes, and the most bits
#: of all (256 MB), which are broadcast in rows of BLOCK bits.
BITS_A_WINDOW, MOST_BITS, BLOCK = 64, 1 << 31, 1 << 12
#: Characters of a text that are looked at in one piece.
PIECE_CHARS = 1 << 20
#: What separates words, before and after A-Z are in lower case.
NOT_WORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
NOT_WORD_ANY_CASE = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def _normal(text: Column) -> Column:
    """The text's words, A-Z in lower case, with one space between them."""
    return F.trim(F.regexp_replace(ascii_lower(text), f"[{NOT_WORD}]+", " "))


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{NOT_WORD_ANY_CASE}]+")).cast("long")


def _places(words: Column, n: int) -> Column:
    """Where a run of n words can begin."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _key(words: Column, place: Column, n: int) -> Column:
    """64-bit hash of the n words from a place on."""
    return F.xxhash64(F.slice(words, place + 1, n))


def benchmark_windows(
    benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(key, gram, len, items): each window of the benchmark, its hash, and the items that have it: their ids as strings, sorted.

    Rows with a null id or no words have no window; rows that share an id are one item.
    """
    items = benchmark.select(
        benchmark[id_col].cast("string").alias("item"), _normal(text_column(benchmark, text_col)).alias("gram")
    ).where("item IS NOT NULL AND gram != ''")
    words = items.withColumn("words", F.split("gram", " ")).withColumn("len", F.least(F.size("words"), F.lit(n)))
    long = words.where(F.size("words") > n).select("item", "words", "len", F.explode(_places(F.col("words"), n)).alias("at"))
    grams = words.where(F.size("words") <= n).select("item", "len", "gram").unionByName(
        long.select("item", "len", F.array_join(F.slice("words", F.col("at") + 1, n), " ").alias("gram"))
    )
    return (
        grams.groupBy("gram", "len")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("key", F.xxhash64(F.split("gram", " ")))
    )


def _pieces(docs: DataFrame, id_col: str, text_col: str, longest: int, piece_chars: int) -> DataFrame:
    """(id, text_hash, before, words): each document's words, a long one's in pieces that share `longest` characters.

    before: the document's words before those of the piece. A window of `longest` characters at most that begins in
    a piece ends in it. Words that a piece cuts are left out of it.
    """
    text = text_column(docs, text_col)
    normal = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), _normal(text).alias("normal"))
    last = F.greatest(F.lit(0), F.floor((F.char_length("normal") - 1) / F.lit(piece_chars))).cast("int")
    placed = normal.withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
    begin, asked = F.col("piece") * piece_chars, piece_chars + longest + 3  # with the character before, to see whether it ends a word
    earlier = F.substring("normal", F.lit(1), begin - 1)
    before = F.when(F.col("piece") == 0, 0).otherwise(1 + F.char_length(earlier) - F.char_length(F.replace(earlier, F.lit(" "), F.lit(""))))
    read = F.when(F.col("last") == 0, F.col("normal")).otherwise(F.substring("normal", F.greatest(begin, F.lit(1)), F.lit(asked)))
    words = placed.select("id", "text_hash", "piece", "last", before.cast("int").alias("before"), read.alias("read"))
    words = words.withColumn("words", F.when(F.col("read") == "", F.array().cast("array<string>")).otherwise(F.split("read", " ")))
    first, cut = F.when(F.col("piece") == 0, 1).otherwise(2), F.when(F.char_length("read") == asked, 1).otherwise(0)
    whole = F.slice("words", first, F.greatest(F.size("words") - first + 1 - cut, F.lit(0)))
    return words.select("id", "text_hash", "before", F.when(F.col("last") == 0, F.col("words")).otherwise(whole).alias("words"))


def _bits(windows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """((block, bits), how many bits): a set bit for each key's last digits, BLOCK bits a row."""
    many = max(BLOCK, min(MOST_BITS, 1 << (n * BITS_A_WINDOW - 1).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(many - 1))
    set_ = windows.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit"))
    words = set_.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    by_block = words.groupBy(F.shiftright("word", (BLOCK // 64).bit_length() - 1).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(BLOCK // 64 - 1)), "bits"))).alias("of")
    )
    row = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.col("of")[i.cast("long")], F.lit(0).cast("long")))
    return by_block.select("block", row.alias("row")), many


def _item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """windows with a number in place of each list of items, and (item_set, items): equal lists have one number."""
    sets = written(windows.select("items").distinct().withColumn("item_set", F.monotonically_increasing_id()))
    return windows.join(sets, "items").drop("items"), sets


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    benchmark_id_col: str = "item_id",
    benchmark_text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """(id, text_hash, pos, len, items): each place where a document has a window of the benchmark. See _hits."""
    hits, sets = _hits(docs, benchmark, n, id_col, text_col, benchmark_id_col, benchmark_text_col, broadcast_windows, piece_chars)
    return hits.join(sets, "item_set").drop("item_set")


def _hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    benchmark_id_col: str = "item_id",
    benchmark_text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
    piece_chars: int = PIECE_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, pos, len, item_set) of each place where a document has a window, and (item_set, items).

    A window carries the number of its set of items, not the items: what a prompt that all items share costs is a number.

    Documents' windows are hashed and probed where they are read; where a hash is met, the words themselves are
    compared. Benchmark windows are counted first: up to `broadcast_windows` are broadcast whole. Of more, a table of
    bits is broadcast (MOST_BITS at most), and only places whose bit is set go to the windows through a shuffle. A
    place may come more than once. Memory for a text is that of its normal form and of one piece's words.
    """
    windows, sets = _item_sets(written(benchmark_windows(benchmark, n, benchmark_id_col, benchmark_text_col)))
    windows = written(windows)
    seen = windows.groupBy("len").agg(F.count("*").alias("n"), F.max(F.char_length("gram")).alias("longest")).collect()  # n rows at most
    lengths, count = sorted(r.len for r in seen), sum(r.n for r in seen)
    pieces = _pieces(docs, id_col, text_col, max((r.longest for r in seen), default=0), piece_chars)

    def keys(k: int) -> Column:
        return F.struct(F.lit(k).alias("len"), F.transform(_places(F.col("words"), k), lambda i: _key(F.col("words"), i, k)).alias("keys"))

    lists = F.array(*map(keys, lengths or [n]))
    probes = (
        pieces.select("id", "text_hash", "before", "words", F.explode(lists).alias("of"))
        .select("id", "text_hash", "before", "words", "of.len", F.posexplode("of.keys").alias("at", "key"))
    )
    known = windows.select("key", F.col("len").alias("known_len"), "gram", "item_set")
    pos = (F.col("before") + F.col("at")).alias("pos")
    said = F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ")

    def same(words: Column | str) -> Column:
        # No equality of columns: it would become a join key, and be made for every place instead of those whose hash is met.
        words = F.col(words) if isinstance(words, str) else words
        return (F.col("len") - F.col("known_len") == 0) & F.startswith(words, F.col("gram")) & F.startswith(F.col("gram"), words)

    if count <= broadcast_windows:
        return probes.join(F.broadcast(known), "key").where(same(said)).select("id", "text_hash", pos, "len", "item_set"), sets
    table, many = _bits(windows, count)
    slot = F.col("key").bitwiseAND(F.lit(many - 1))
    bit = F.getbit(F.get("row", F.expr(f"CAST(shiftright(key, 6) & {BLOCK // 64 - 1} AS INT)")), F.expr("CAST(key & 63 AS INT)"))
    maybe = probes.withColumn("block", F.shiftright(slot, BLOCK.bit_length() - 1)).join(F.broadcast(table), "block").where(bit == 1)
    met = maybe.select("id", "text_hash", pos, "len", "key", said.alias("said")).join(known, "key")
    return met.where(same("said")).select("id", "text_hash", "pos", "len", "item_set"), sets


def _by_document(hits: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(id, text_hash, n_hit, spans, and items if sets are given): words covered, places covered, items that occur.

    One document a group. Sets of items are looked up once for each that a document has.
    """
    before = (
        Window.partitionBy("id", "text_hash").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("pos") + F.col("len")
    covered = F.coalesce(F.max(end).over(before), F.lit(0))
    covered_by = (
        hits.withColumn("covered", covered)
        .withColumn("gain", F.greatest(F.lit(0), end - F.greatest("pos", "covered")))
        .groupBy("id", "text_hash")
        .agg(
            F.sum("gain").alias("n_hit"),
            F.collect_set("item_set").alias("item_sets"),
            F.array_sort(F.collect_set(F.struct("pos", end.alias("end")))).alias("spans"),
        )
    )
    if sets is None:
        return covered_by.drop("item_sets")
    covered_by = written(covered_by)
    each = covered_by.select("id", "text_hash", F.explode("item_sets").alias("item_set")).join(sets, "item_set")
    each = each.select("id", "text_hash", F.explode("items").alias("item")).groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = each.withColumnsRenamed({"id": "_id", "text_hash": "_text_hash"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return covered_by.join(each, same).select("id", "text_hash", "n_hit", "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_percent: int = 5, **columns) -> DataFrame:
    """One row for each row of docs: (id, n_words, n_hit, n_items, items_sha256, contaminated).

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. An item's windows are its
    runs of n words; a shorter item with words is one window. A document's word inside any occurrence of a
    window is hit. A document is contaminated when it has hits, and 100 * n_hit >= min_percent * n_words.

    Nulls and empty texts have no words, hits or items, and are clean. A null id is a document like any other.
    Repeated rows get the same verdict; rows with one id and different texts are judged apart. An empty
    benchmark hits nothing; items with a null id or no words are ignored. Further columns are ignored.
    `columns` are as for find_hits.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    found = _by_document(*_hits(docs, benchmark, n, **columns))
    text = text_column(docs, text_col)
    words = docs.select(
        docs[id_col].alias("doc"),
        F.xxhash64(text).alias("hash"),
        _n_words(text).alias("n_words"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return words.join(
        found, words["doc"].eqNullSafe(found["id"]) & (words["hash"] == found["text_hash"]), "left"
    ).select(
        F.col("doc").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= min_percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, min_percent: int = 5, **columns
) -> DataFrame:
    """docs, in its own columns, without contaminated documents or (remove="spans") without the words hit.

    "spans" takes out each hit word with the separators before it, and leaves other rows and null texts alone. Null
    and empty texts are clean; null ids, repeated ids and repeated rows are judged as in contamination. An empty
    table gives none, an empty benchmark takes nothing. Columns of any name are kept as they are.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    hash_ = F.xxhash64(text_column(docs, text_col))
    id_, text_hash, n_hit, spans = free_names(docs, "id", "text_hash", "n_hit", "spans")
    found = _by_document(_hits(docs, benchmark, n, **columns)[0]).select(
        F.col("id").alias(id_), F.col("text_hash").alias(text_hash), F.col("n_hit").alias(n_hit), F.col("spans").alias(spans)
    )
    same = docs[id_col].eqNullSafe(found[id_]) & (hash_ == found[text_hash])
    if remove == "documents":
        too_much = 100 * found[n_hit] >= min_percent * _n_words(text_column(docs, text_col))
        return docs.join(found.drop(spans), same & too_much, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    joined = docs.join(found, same, "left")
    pieces = F.regexp_extract_all(docs[text_col], F.lit(f"[{NOT_WORD_ANY_CASE}]*[^{NOT_WORD_ANY_CASE}]+"), F.lit(0))
    tail = F.regexp_extract(docs[text_col], f"[{NOT_WORD_ANY_CASE}]*$", 0)
    left = F.filter(pieces, lambda piece, i: ~F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["end"])))
    cleaned = F.when(F.col(spans).isNull(), docs[text_col]).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.select(*(cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns))
