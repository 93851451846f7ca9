"""Columns of users whose names the operators use inside."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontam, exact, minhash
from graphloom.llm.common import only_rows, row_hash

NAMES = ("__id", "__hash", "__json", "__first", "__spans", "__n_hit", "id", "hash", "copies", "JSON", "first", "spans", "text_hash", "n_hit", "_id")
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture
def table(spark):
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(1, TEXT), (1, TEXT), (2, TEXT + " more"), (3, None), (None, "x"), (None, "x"), (4, "other words")]
    return spark.createDataFrame([(i, t, *NAMES) for i, t in rows], f"doc_id long, text string, {extra}")


def test_only_rows_with_clashing_columns(table):
    chosen = table.groupBy(F.col("doc_id").alias("i"), row_hash(table, "text").alias("h")).agg(F.count("*").alias("n")).toDF("id", "hash", "copies")
    got = only_rows(table, chosen, "doc_id", "text")
    assert got.columns == table.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "None"]
    assert all(r[n] == n for r in got.collect() for n in NAMES)


@pytest.mark.parametrize("drop", [exact.drop_exact_duplicates, minhash.drop_near_duplicates])
def test_dedup_with_clashing_columns(table, drop):
    got = drop(table)
    assert got.columns == table.columns
    assert got.where("doc_id = 1").count() == 1
    assert all(r[n] == n for r in got.collect() for n in NAMES)


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminate_with_clashing_columns(spark, table, remove):
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    got = decontam.decontaminate(table, bench, remove)
    assert got.columns == table.columns
    assert got.count() == (4 if remove == "documents" else 7)
    assert all(r[n] == n for r in got.collect() for n in NAMES)
    if remove == "spans":
        assert sorted(str(r.text) for r in got.collect()) == sorted(["", "", " more", "None", "x", "x", "other words"])
