"""Helpers that several operators share: normal forms of text and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode gets a temporary one.

    On a cluster a machine's own folder would lose what other machines write, so there an unset folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. lower() does just that to pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def without_spaces(text: Column) -> Column:
    """text without any character of SPACE_CLASS; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def text_column(df: DataFrame, name: str) -> Column:
    """The named column as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def row_hash(df: DataFrame, text_col: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(text_column(df, text_col))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names with as many underscores in front as keep them apart from df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def only_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, in its own columns, with one row for each of chosen(id, hash, copies): those of that id and row_hash.

    copies: how many rows docs has of it. Of more than one, that whose columns come first as JSON stays. Columns of docs
    may have any names.
    """
    id_, hash_, copies, json, first = free_names(docs, "id", "hash", "copies", "json", "first")
    chosen = written(chosen.select(F.col("id").alias(id_), F.col("hash").alias(hash_), F.col("copies").alias(copies)))
    same = docs[id_col].cast("long").eqNullSafe(chosen[id_]) & (row_hash(docs, text_col) == chosen[hash_])
    if chosen.where(F.col(copies) > 1).isEmpty():
        return docs.join(chosen, same, "left_semi")
    once = docs.join(chosen.where(F.col(copies) == 1), same, "left_semi")
    repeated = docs.join(chosen.where(F.col(copies) > 1), same)
    repeated = repeated.withColumn(json, F.to_json(F.struct(*(docs[c] for c in docs.columns))))
    kept = repeated.withColumn(first, F.row_number().over(Window.partitionBy(id_, hash_).orderBy(json))).where(F.col(first) == 1)
    return once.unionByName(kept.select(*docs.columns))
