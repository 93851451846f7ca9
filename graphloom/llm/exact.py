"""Exact de-duplication with a heavy-hitter split. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import only_rows, row_hash, text_column, without_spaces, written

#: Digests that the frequent-items summary may hold, and the most that are taken from it: the bound on what is
#: broadcast, whatever the input.
TRACKED = 4096
FREQUENT = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_points, hash) of each row: SHA-256 of the text without white space, code points and hash of the text."""
    text = text_column(docs, text_col)
    return docs.select(
        docs[id_col].alias("id"),
        F.unhex(F.sha2(without_spaces(text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_points"),
        row_hash(docs, text_col).alias("hash"),
    )


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, keep, n): of each digest the longest row, then the smallest id, and the number of rows."""
    rank = F.struct("n_points", F.bitwise_not("id").alias("not_id"))
    return rows.groupBy("digest").agg(F.max(rank).alias("best"), F.count("*").alias("n")).select(
        "digest", F.bitwise_not("best.not_id").alias("keep"), "n"
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, frequent: int = FREQUENT
) -> DataFrame:
    """One row for each row of docs: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical without `[\\x20\\x09-\\x0D]`. Of equal texts the row with the most
    code points stays, then the one with the smallest id.

    Method: approx_top_k, a mergeable Misra-Gries summary of bounded size, names the frequent digests. Their
    exact winners are counted with map-side combination, and broadcast (at most `frequent` rows), so that rows
    of large groups never cross the network. The other digests, each a small share of the rows, are shuffled
    in the usual way. The summary only decides which way a digest goes; both ways give the same result.

    Null texts count as empty. Rows with a null id take part and lose ties against any other id; if all rows
    of a group have null ids, keep_id is null and kept true. Rows with the same id and text are the same
    document and get the same verdict. Empty table: no rows. Other columns are ignored. The id must be an
    integer.
    """
    judged = _judged(docs, id_col, text_col, tracked, frequent)
    return judged.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """The rows of digests() with keep and n of their group."""
    rows = written(digests(docs, id_col, text_col))
    top = rows.agg(F.expr(f"approx_top_k(hex(digest), {frequent}, {tracked})").alias("top"))
    heavy = top.select(F.explode("top").alias("t")).where("t.count > 1").select(
        F.unhex("t.item").alias("digest")
    )
    winners = written(_winners(rows.join(F.broadcast(heavy), "digest", "left_semi")))
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return rows.join(F.broadcast(winners), "digest").unionByName(light.join(_winners(light), "digest"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its own columns, with one row of each group of equal texts: that which exact_duplicates keeps.

    Where several rows of the group have that id, the longest text stays, then that with the least hash, and of
    rows repeated whole one. Null texts count as empty, so one row of all empty texts stays; null ids lose ties.
    Empty table: no rows. Columns of any name are kept as they are. The id must be an integer.
    """
    kept = _judged(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("keep")))
    best = F.struct((-F.col("n_points")).alias("n"), "hash", "id")
    # One row a group here, or a few that share an id: nothing to combine.
    chosen = kept.groupBy("digest", "id", "n_points", "hash").agg(F.count("*").alias("copies"))
    chosen = chosen.groupBy("digest").agg(F.min_by(F.struct("id", "hash", "copies"), best).alias("c")).select("c.*")
    return only_rows(docs, chosen, id_col, text_col)
