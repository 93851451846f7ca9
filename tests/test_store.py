"""The stored layout of triples: same solutions as the text form, and stars without a shuffle."""

import time
from functools import reduce
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.operators import pattern as pt
from graphloom.operators.numbering import numbered, written
from graphloom.sources import store as st
from graphloom.sources.relational import triples
from graphloom.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"
STAR = (("placedBy", "?customer"), ("date", "?date"), ("total", "?total"), ("status", "?status"))


@pytest.fixture(scope="module")
def view(spark):
    # Lines have surrogate numbers, which the files' layout decides: written once, they stay.
    return written(triples(spark, SF))


@pytest.fixture(scope="module")
def store(view, tmp_path_factory):
    return st.TripleStore.create(view, str(tmp_path_factory.mktemp("store")), 4)


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty()
    assert b.exceptAll(a).isEmpty()


def star_of_text(view, subject="order", patterns=STAR):
    return pt.conjunction(*(pt.match(view, f"?{subject}", p, o) for p, o in patterns))


def test_star_equals_text_form_without_a_shuffle(spark, store, view):
    expected = star_of_text(view)
    assert expected.count() == view.where("p = 'placedBy'").count() > 1000
    same(store.texts(store.star("?order", *STAR), *expected.columns), expected)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.star("?order", *STAR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 3
    assert "Exchange" not in plan
    assert plan.count("PushedFilters: [IsNotNull(p), EqualTo(p,") == 4


def test_whole_table_comes_back_reopened(spark, store, view):
    again = st.TripleStore(spark, store.path)
    same(again.triples().select(*view.columns), view)
    again.close()
    ids = store.terms()
    assert ids.count() == ids.select("id").distinct().count() == ids.select("text").distinct().count() == ids.agg(F.max("id")).first()[0]


def test_patterns_equal_text_form(store, view):
    for s, p, o in (("?x", "inNation", "nation/3"), ("customer/7", "inNation", "?n"), ("?x", "skos:broader", "?y"), ("?x", "inNation", "nowhere"), ("nobody", "date", "?d")):
        expected = pt.match(view, s, p, o)
        same(store.texts(store.match(s, p, o), *expected.columns), expected)
    by_object = store.star("?nation", ("inNation", "?who"), ("linkedTo", "?other"), key="o")
    expected = pt.conjunction(pt.match(view, "?who", "inNation", "?nation"), pt.match(view, "?other", "linkedTo", "?nation")).select("nation", "who", "other")
    same(store.texts(by_object, "nation", "who", "other"), expected)


def test_a_constant_reads_one_bucket(spark, store):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = store.match("customer/7", "inNation", "?n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in plan


def test_heavy_terms_lie_apart(view, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "HEAVY_ROWS", 1000)
    heavy = st.TripleStore.create(view, str(tmp_path / "heavy"), 4)
    assert heavy._read("heavy_s") is None
    assert heavy._read("heavy_o").count() > 5000  # classes, nations, segments
    same(heavy.triples().select(*view.columns), view)
    expected = pt.conjunction(pt.match(view, "?line", pt.TYPE, "?class"), pt.match(view, "?other", pt.TYPE, "?class")).where("class = 'Nation'")
    found = heavy.texts(heavy.star("?class", (pt.TYPE, "?line"), (pt.TYPE, "?other"), key="o"), "class", "line", "other").where("class = 'Nation'")
    same(found.select(*expected.columns), expected)
    same(heavy.texts(heavy.match("?x", pt.TYPE, "Order"), "x"), pt.match(view, "?x", pt.TYPE, "Order"))


def test_batches_add_up_and_broken_ones_are_not_read(spark, view, tmp_path, monkeypatch):
    first, second = view.where("p IN ('placedBy', 'date', 'total', 'inNation')"), view.where("p IN ('status', 'rdfs:label')")
    store = st.TripleStore.create(first, str(tmp_path / "batches"), 4)
    last = store.terms().agg(F.max("id")).first()[0]
    with monkeypatch.context() as m:
        m.setattr(store, "_note", lambda kind, batch, note=store._note: note(kind, batch) if kind == "begun" else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.append(second)
    same(store.triples().select(*view.columns), first)
    store.append(second)
    same(store.triples().select(*view.columns), first.unionAll(second))
    same(store.texts(store.star("?order", *STAR), "order", "customer", "date", "total", "status"), star_of_text(view))
    new = store._read("terms_by_id").where(F.col("batch") > 1)
    assert new.agg(F.min("id")).first()[0] == last + 1


def test_nulls_and_empty_tables(spark, tmp_path):
    schema = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
    rows = [("a", "p", "b", "uri", None, None), ("a", "p", "b", "uri", None, None), (None, "p", "b", "uri", None, None), ("a", None, "b", "uri", None, None), ("a", "p", None, "uri", None, None)]
    table = spark.createDataFrame(rows, schema)
    store = st.TripleStore.create(table, str(tmp_path / "nulls"))
    same(store.triples().select(*table.columns), table.limit(2))
    empty = st.TripleStore.create(table.limit(0), str(tmp_path / "empty"))
    assert empty.triples().isEmpty()
    assert empty.star("?x", ("p", "?y"), ("p", "b")).isEmpty()


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k")).repartition(7)
    got = numbered(rows, [F.desc("k")], "n", 10).collect()
    assert [r.n for r in sorted(got, key=lambda r: -r.k)] == list(range(10, 5010))
    assert numbered(rows.limit(0), ["k"]).columns == ["k", "row"]


def test_a_file_a_bucket_sorted_by_predicate_and_key(spark, view, tmp_path):
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store = st.TripleStore.create(view, str(tmp_path / "sorted"), 4)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting
    for table, order in (("by_s", ["p", "s"]), ("by_o", ["p", "o"]), ("terms_by_id", ["id"]), ("terms_by_text", ["text"])):
        files = sorted((tmp_path / "sorted" / table).glob("*.parquet"))
        assert len(files) == 4
        for f in files:
            rows = [tuple(r) for r in spark.read.parquet(str(f)).select(*order).coalesce(1).collect()]
            assert rows == sorted(rows) and rows
    store.close()


def test_counts_by_predicate_shuffle_no_triples(spark, view, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "HEAVY_ROWS", 1000)
    first = view.where("p IN ('placedBy', 'date', 'rdf:type')")
    store = st.TripleStore.create(first, str(tmp_path / "counts"), 4)
    store.append(view.where("p NOT IN ('placedBy', 'date', 'rdf:type')"))
    expected = view.groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))
    same(store.predicate_counts(), expected)
    plain = st.TripleStore.create(first, str(tmp_path / "plain"), 4)
    monkeypatch.setattr(plain, "_branches", lambda key: [plain._read(f"by_{key}")])
    plan = plain.predicate_counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(p#") == 2
    assert ", s#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize(("frequent", "held"), [(0, 0), (0, 1 << 40), (50, 0), (1 << 40, 1 << 40)])
def test_frequent_terms_are_not_shuffled_and_any_join_gives_the_same(spark, view, tmp_path, monkeypatch, frequent, held):
    monkeypatch.setattr(st, "FREQUENT", frequent)
    monkeypatch.setattr(st, "HELD_BYTES", held)
    store = st.TripleStore.create(view.where("p <> 'rdf:type'"), str(tmp_path / "any"), 4)
    store.append(view.where("p = 'rdf:type'"))
    same(store.triples().select(*view.columns), view)
    ids = store.terms()
    assert ids.count() == ids.select("text").distinct().count() == ids.agg(F.max("id")).first()[0]


def test_only_the_store_stays_on_disk(spark, view, tmp_path):
    shared = Path(shared_folder(spark).removeprefix("file:"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in disk.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in x}

    tables, shuffled, settings = set(shared.glob("graphloom-*")), shuffles(), {name: spark.conf.get(name) for name in st._SETTINGS}
    store = st.TripleStore.create(view.where("p <> 'status'"), str(tmp_path / "small"), 4)
    store.append(view.where("p = 'status'"))
    assert set(shared.glob("graphloom-*")) == tables
    for _ in range(50):  # they go in the background
        if shuffles() <= shuffled:
            break
        time.sleep(0.2)
    assert shuffles() <= shuffled
    assert {name: spark.conf.get(name) for name in st._SETTINGS} == settings
    for table in st._TABLES:
        for f in (tmp_path / "small" / table).glob("*.parquet"):
            assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"
    same(store.triples().select(*view.columns), view)


def test_slices_give_the_same(spark, view, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "SLICE_ROWS", 5000)
    monkeypatch.setattr(st, "MOST_SLICES", 4)
    monkeypatch.setattr(st, "HEAVY_ROWS", 1000)
    lines = view.where("p IN ('ofOrder', 'ofPart', 'rdf:type')")
    heavy = spark.range(2000).select(F.lit("order/1").alias("s"), F.lit("ofPart").alias("p"), F.concat(F.lit("x"), "id").alias("o"), *(F.lit(v).cast("string").alias(c) for c, v in (("o_kind", "uri"), ("o_dt", None), ("o_lang", None))))
    first = lines.unionAll(heavy)
    second = view.where("p NOT IN ('ofOrder', 'ofPart', 'rdf:type')")
    store = st.TripleStore.create(first, str(tmp_path / "slices"), 6)
    assert store._read("heavy_s").count() >= 2000
    same(store.triples().select(*view.columns), first)
    assert len(list((tmp_path / "slices" / "by_o").glob("*.parquet"))) == 6  # parts of the buckets, not of a bucket
    store.append(second)
    same(store.triples().select(*view.columns), first.unionAll(second))
    other = reduce(type(view).unionAll, store._branches("o")).drop("batch")
    same(store.texts(other, "s", "o").select(*view.columns), first.unionAll(second))
    ids = store.terms()
    assert ids.count() == ids.select("text").distinct().count() == ids.agg(F.max("id")).first()[0]


def test_a_batch_that_broke_off_early_can_come_again(spark, view, tmp_path, monkeypatch):
    store = st.TripleStore.create(view.where("p = 'date'"), str(tmp_path / "early"), 4)
    with monkeypatch.context() as m:
        m.setattr(store, "_looked_up", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.append(view.where("p = 'status'"))
    store.append(view.where("p = 'status'"))
    same(store.triples().select(*view.columns), view.where("p IN ('date', 'status')"))
