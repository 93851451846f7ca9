"""Sharding by extendible hashing. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_column, written

#: Bits of the hash that a directory can use; rows that agree in all of them cannot be split.
HASH_BITS = 60
#: Bits beyond the expected depth in the first round, and bits that each later round adds.
SLACK_BITS, ROUND_BITS = 4, 8
#: Most leaves of the directory that are broadcast (24 bytes each); a larger directory is joined by a shuffle.
BROADCAST_LEAVES = 1_000_000


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long. A null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(hash_: Column | str, bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col(hash_) if isinstance(hash_, str) else hash_, F.lit(HASH_BITS) - bits)


def _leaves(cells: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """Buckets between two depths that hold the cells: (depth, prefix, bytes, docs, over).

    A bucket is a leaf if it fits and its parent does not. Those at the lowest depth that do not fit are marked
    over, as are buckets of one row, which no bit can split. Every cell counts towards one bucket of each depth;
    sums of sums are small, since cells are combined already.
    """
    levels = F.sequence(F.lit(top), F.lit(bottom))
    nodes = (
        cells.select(F.explode(levels).alias("depth"), "cell", "bytes", "docs")
        .withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(bottom) - F.col("depth")))
        .groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    )
    done = (F.col("bytes") <= limit) | (F.col("docs") == 1)
    parents = nodes.where(done).select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    )
    split_parent = nodes.join(parents, ["depth", "prefix"], "left_anti")
    return split_parent.where(done | (F.col("depth") == bottom)).withColumn("over", ~done)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The directory for sizes(hash, bytes): (depth, prefix, bytes, docs), one row a bucket (leaf).

    Rounds read the rows' sizes by their first bits, and go on with the next bits for oversized buckets alone,
    so the first round nearly always ends it. A bucket still over the limit at 60 bits holds rows of one hash;
    it stays whole.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bottom = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    top, left, found = 0, sizes, []
    while True:
        cells = left.groupBy(_prefix("hash", bottom).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs")
        )
        leaves = written(_leaves(cells, top, bottom, limit))
        over = leaves.where("over").select(F.col("prefix").alias("over_prefix"))
        if bottom == HASH_BITS or over.isEmpty():
            found.append(leaves)
            break
        found.append(leaves.where("NOT over"))
        left = left.join(over, _prefix("hash", bottom) == F.col("over_prefix"), "left_semi")
        top, bottom = bottom + 1, min(HASH_BITS, bottom + ROUND_BITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("over")


def shards(
    docs: DataFrame,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_leaves: int = BROADCAST_LEAVES,
) -> DataFrame:
    """One row for each row of docs: (id, shard_id, depth, text_bytes, shard_bytes, shard_docs, oversized).

    limit: most bytes of UTF-8 text in a shard. The directory starts as one bucket; a bucket over the limit
    splits on the next bit of the id's hash, until each fits. shard_id is the bucket's prefix in bits
    (empty for a single bucket). A document of more than `limit` bytes gets a shard of its own, and rows that
    share an id share a shard; such shards alone can be over the limit, and are marked oversized.

    Null texts have no bytes; null ids count as the empty key. Empty table: no rows. Other columns are ignored.
    The directory, a few rows for each shard, is broadcast up to `broadcast_leaves` rows, else shuffled.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    sizes = written(_sizes(docs, id_col, text_col))
    leaves = written(directory(sizes.select("hash", "bytes"), limit))
    return _placed(sizes, leaves, broadcast_leaves).select(
        F.col("id").alias(id_col),
        "shard_id",
        "depth",
        F.col("bytes").alias("text_bytes"),
        "shard_bytes",
        "shard_docs",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].alias("id"),
        hash_bits(docs[id_col]).alias("hash"),
        F.octet_length(text_column(docs, text_col)).cast("long").alias("bytes"),
    )


def _placed(rows: DataFrame, leaves: DataFrame, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """rows, which have a column hash, with shard_id, depth, shard_bytes and shard_docs of their bucket in the directory."""
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # 61 values at most
    leaves = leaves.withColumnsRenamed({"bytes": "shard_bytes", "docs": "shard_docs"})
    if leaves.count() <= broadcast_leaves:
        leaves = F.broadcast(leaves)
    probes = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths or [0])))).withColumn("prefix", _prefix("hash", F.col("depth")))
    bits = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    return probes.join(leaves, ["depth", "prefix"]).withColumn("shard_id", bits)


def write_shards(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the rows of docs as Parquet, one folder shard_id=b<bits> for each of shards().

    The b keeps readers from taking the bits for a number. A row's shard follows from its id and the directory, so
    texts cross the network once; each shard is one task's. Null texts have no bytes, null ids count as the empty key,
    repeated rows are all written, and an empty table gives no shard. A column of docs named shard_id is written as
    shard_id_ (with more underscores if that is taken, too), others as they are.
    """
    leaves = written(directory(_sizes(docs, id_col, text_col).select("hash", "bytes"), limit))
    names = [c.lower() for c in docs.columns]
    renamed = "shard_id_"
    while renamed in names:
        renamed += "_"
    row = F.struct(*(docs[c].alias(renamed if c.lower() == "shard_id" else c) for c in docs.columns))
    placed = _placed(docs.select(hash_bits(docs[id_col]).alias("hash"), row.alias("row")), leaves)
    placed.select("row.*", F.concat(F.lit("b"), "shard_id").alias("shard_id")).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
