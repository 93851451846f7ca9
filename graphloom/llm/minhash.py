"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.common import only_rows, row_hash, text_column, written

SHINGLE_WORDS = 5
#: Similarity from which documents are linked, in hundredths.
SIMILAR = 80
#: Two collections of SIDES sub-signatures, each of ROWS minhashes. A table's key is a pair, one of each, so
#: 2 * SIDES * ROWS = 160 minhashes serve SIDES ** 2 = 400 tables of 2 * ROWS rows, which would else take 3,200.
#: A pair at similarity 0.8 is missed if it agrees in no sub-signature of one side: 2 * (1 - 0.8 ** 4) ** 20 = 5e-5.
SIDES, ROWS = 20, 4
SEED = 7
_BLOCK = 1024  # shingles that are hashed at once
_MULT, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words, A-Z in lower case; of all words if there are fewer."""
    words = text.encode(errors="surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, k = len(words), min(k, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out + hashes[j : n - k + 1 + j])
    return np.unique(out)


def sub_signatures(hashes: np.ndarray, sides: int = SIDES, rows: int = ROWS) -> np.ndarray:
    """Shape (2, sides): one number for each sub-signature of both collections."""
    rng = np.random.default_rng(SEED)
    mult, add = rng.integers(0, 2**63, (2, 2 * sides * rows), np.uint64)
    least = np.full(2 * sides * rows, np.iinfo(np.uint64).max, np.uint64)
    mult = (mult << np.uint64(1)) | np.uint64(1)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[None, at : at + _BLOCK] * mult[:, None] + add[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    out = np.tile(np.arange(sides, dtype=np.uint64), (2, 1))
    for row in least.reshape(2, sides, rows).transpose(2, 0, 1):
        out = _mix(out + row)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text, k) for text in batch["text"].to_pylist()]
        sides = [sub_signatures(s).view(np.int64) if len(s) else np.empty((2, 0), np.int64) for s in sets]
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch["id"],
                "hash": batch["hash"],
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "a": _lists([s[0] for s in sides]),
                "b": _lists([s[1] for s in sides]),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text, k).view(np.int64) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"id": batch["id"], "items": _lists(sets)})


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another class has too."""
    met = rows.groupBy(key).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select(key)
    return rows.join(met, key)


def _tables(classes: DataFrame) -> DataFrame:
    """(key, rep, n): the tables' entries of the classes that can meet another in them.

    A class that is alone in a sub-signature is alone in each table with it, so only shared sub-signatures of
    the two sides are paired; most documents pair none.
    """
    a = _shared(classes.select("rep", "n", F.explode("a").alias("a")), "a")
    b = _shared(classes.select("rep", F.explode("b").alias("b")), "b")
    return _shared(a.join(b, "rep").select(F.xxhash64("a", "b").alias("key"), "rep", "n"), "key").select("key", "rep", "n")


def _full_sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, items): the shingle sets of the given ids; rows that share an id put theirs together."""
    found = texts.select("id", "text").join(ids, "id", "left_semi").mapInArrow(lambda it: _sets(it, k), "id long, items array<long>")
    return written(found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b")


def _sizes_agree(n: str, m: str, similar: int):
    return (100 * F.col(n) >= similar * F.col(m)) & (100 * F.col(m) >= similar * F.col(n))


def _across(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members(id, part) of different parts that can be similar enough.

    Items that only one part has are in no intersection across parts, and are left out first: what a set has of them it
    lacks of the other, which rules most texts of a family out by themselves. The rest is ranked by how many members have
    it, so what a family shares ranks last. Of two sets of x and y items that need an overlap of t / (1 + t) * (x + y),
    with p and q left, the first p - overlap + 1 and q - overlap + 1 have one in common. Sizes are met by bands,
    since the overlap depends on both, and the join asks for the ranks that the two sizes themselves allow.

    A meeting has one side outside the part that has most of its rows, so rows of one part do not meet each other: at most
    twice as many are looked at as there are meetings across parts. The pairs' heads, half as long again as their prefixes,
    are compared last: past them only so many items can follow, so few pairs get to their full sets.
    """
    t, band = similar / 100, math.log(1.05)
    reach = math.ceil(-math.log(t) / band)
    items = sets.join(members, "id").select("id", "part", F.size("items").alias("n"), F.explode("items").alias("item"))
    known = items.groupBy("item").agg(F.count("*").alias("f"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    own = Window.partitionBy("id")
    ranked = (
        items.join(known.select("item", "f"), "item")
        .withColumn("left", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("f", "item")))
        .where(F.col("left") >= F.ceil(F.lit(t) * F.col("n") - 1e-6))
    )

    def overlap(n, m):
        return F.ceil(F.lit(t / (1 + t)) * (n + m) - 1e-6)

    least = F.ceil(F.lit(t) * F.col("n") - 1e-6)  # of the smallest partner
    beyond = F.col("left") - overlap(F.col("n"), least)
    ranked = written(ranked.where(F.col("rank") <= beyond + 1 + F.floor(beyond / 2)).withColumn("band", F.floor(F.log("n") / band)))
    smallest = F.greatest(F.floor(F.exp(F.col("other") * band) - 1e-6), least)
    keyed = (
        ranked.withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
        .where(F.col("rank") <= F.col("left") - overlap(F.col("n"), smallest) + 1)
        .withColumn("low", F.least("band", "other"))
        .withColumn("high", F.greatest("band", "other"))
    )
    key = ["item", "low", "high"]
    mixed = (
        keyed.groupBy(*key, "part").agg(F.count("*").alias("rows"))
        .groupBy(*key).agg(F.max_by("part", F.struct("rows", "part")).alias("top"), F.count("*").alias("parts"))
        .where("parts > 1").drop("parts")
    )
    keyed = keyed.select(*key, "id", "part", "n", "left", "rank", "band", "other").join(mixed, key)

    def side(x: str) -> DataFrame:
        return keyed.select(*key, *(F.col(c).alias(c + x) for c in ("id", "part", "n", "left", "rank", "band", "other", "top")))

    needed = overlap(F.col("na"), F.col("nb"))
    met = side("a").join(side("b").where("partb != topb"), key)
    met = met.where(
        (F.col("parta") != F.col("partb"))
        & ((F.col("parta") == F.col("topa")) | (F.col("ida") < F.col("idb")))
        & (F.col("banda") == F.col("otherb")) & (F.col("bandb") == F.col("othera"))
        & _sizes_agree("na", "nb", similar)
        & (F.col("ranka") <= F.col("lefta") - needed + 1) & (F.col("rankb") <= F.col("leftb") - needed + 1)
    )
    pairs = met.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    heads = written(
        ranked.groupBy("id").agg(
            F.first("n").alias("n"), F.first("left").alias("left"), F.collect_list("item").alias("head")
        ).withColumn("rest", F.col("left") - F.size("head")).drop("left")
    )
    for x in ("a", "b"):
        pairs = pairs.join(heads.select(*(F.col(c).alias(c if c == "id" else c + x) for c in heads.columns)).withColumnRenamed("id", x), x)
    common = F.size(F.array_intersect("heada", "headb"))
    return pairs.where(common + F.greatest("resta", "restb") >= needed).select("b", "a")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similar: int = SIMILAR,
) -> DataFrame:
    """One row for each row of docs: (id, n_shingles, component_id, kept).

    A document's set is its distinct runs of `shingle_words` words, A-Z in lower case; with fewer words, all of
    them as one. Documents are linked when 100 * intersection >= similar * union; component_id is the smallest
    id reachable over links, and the document with that id is kept.

    Steps: documents of equal sets form a class. Tensored banding gives table keys; every class is compared
    with the first class of each of its tables, and links are confirmed on full sets, so a large group of near
    copies costs a few comparisons for each member. Then classes in tables that still hold more than one
    component meet those of other components over their rarest shingles, which leaves out no link, and are
    confirmed likewise.

    Nulls and texts without words have the empty set and link with nothing. Rows with a null id belong to the
    component of their text, and are kept only where no row of the same set has an id. Rows with the same id
    are one node: they share a component. Empty table: no rows. Other columns are ignored. The id must be an
    integer.
    """
    return _judged(docs, id_col, text_col, shingle_words, similar).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similar: int) -> DataFrame:
    """(id, hash, n, component) of each row."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), row_hash(docs, text_col).alias("hash"), text_column(docs, text_col).alias("text"))
    signed = written(
        texts.mapInArrow(
            lambda it: _signed(it, shingle_words), "id long, hash long, n long, digest binary, a array<long>, b array<long>"
        )
    )
    groups = written(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")))
    classes = (
        signed.withColumnRenamed("id", "rep").join(groups.where("rep IS NOT NULL"), ["rep", "digest"]).select("rep", "n", "a", "b")
    )
    tables = written(_tables(classes))
    first = tables.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"))
    spokes = (
        tables.join(first, "key")
        .where("hub.rep < rep")
        .where(_sizes_agree("n", "hub.n", similar))
        .select(F.col("rep").alias("b"), F.col("hub.rep").alias("a"))
        .distinct()
    )
    spokes = written(spokes)
    sets = _full_sets(texts, tables.select(F.col("rep").alias("id")).distinct(), shingle_words)
    links = written(_confirmed(spokes, sets, similar))
    parts = components(links)

    # Members of tables whose classes are not all in one component yet.
    labelled = tables.join(parts, F.col("rep") == F.col("node"), "left").select(
        "key", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("part")
    )
    mixed = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    members = written(labelled.join(mixed, "key").select("id", "part").distinct())
    more = written(_confirmed(_across(members, sets, similar).join(spokes, ["b", "a"], "left_anti"), sets, similar))
    if not more.isEmpty():
        parts = components(links.unionByName(more))

    return (
        signed.select("id", "hash", "n", "digest")
        .join(groups, "digest", "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select("id", "hash", "n", F.coalesce("component", "rep", "id").alias("component"))
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similar: int = SIMILAR
) -> DataFrame:
    """docs, in its own columns, with one row of each component of near_duplicates: one of its smallest id.

    Where several rows have that id, the text with the least hash stays, and of rows repeated whole one. Of rows with
    a null id that are kept, one of each text stays. Null and empty texts are alike, and are copies of nothing with
    another id. Empty table: no rows. Columns of any name are kept as they are. The id must be an integer.
    """
    kept = _judged(docs, id_col, text_col, shingle_words, similar).where(F.col("id").eqNullSafe(F.col("component")))
    counted = kept.groupBy("id", "hash").agg(F.count("*").alias("copies"))
    one = counted.groupBy("id", F.when(F.col("id").isNull(), F.col("hash")).alias("of")).agg(F.min(F.struct("hash", "copies")).alias("c"))
    return only_rows(docs, one.select("id", "c.*"), id_col, text_col)
