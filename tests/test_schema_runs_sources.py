"""Schema graphs, run metrics and sources on hand-made rows."""

import json
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as ev
from graphloom.operators import schema as sc
from graphloom.plans import catalog
from graphloom.sources import readers
from graphloom.sources.relational import triples


@pytest.fixture(scope="module")
def edges(spark):
    chain = [(a, "next", b) for a, b in zip("ABCDEFG", "BCDEFGH", strict=True)]
    return spark.createDataFrame([*chain, ("A", "skip", "C"), ("A", "leap", "B"), ("C", "back", "A"), ("B", "self", "B"), ("C", "name", "Literal")], readers.EDGES)


def shape(paths):
    return sorted(" ".join(s.pred for s in r.path) for r in paths.collect())


def test_simple_paths_bounded_without_repeats(edges):
    assert shape(sc.simple_paths(edges, "A", "C")) == ["leap next", "next next", "skip"]
    assert shape(sc.simple_paths(edges, "A", "F")) == ["leap next next next next", "next next next next next", "skip next next next"]
    assert shape(sc.simple_paths(edges, "B", "H")) == []  # seven nodes
    assert shape(sc.simple_paths(edges, "H", "A")) == [] and shape(sc.simple_paths(edges, "A", "A")) == []


def test_reduced_and_shortest_paths(edges):
    found = sc.simple_paths(edges, "A", "C")
    assert shape(sc.reduce_paths(found.unionAll(found), 1)) == ["leap next", "skip"]
    assert shape(sc.k_shortest_paths(edges, "A", "C", 2)) == ["leap next", "skip"]
    assert shape(sc.paths_with_data(found, edges.where("edge != 'leap'"))) == ["next next", "skip"]


def test_neighbourhood_and_terms(edges):
    assert sc.neighbourhood(edges, "H").count() == 1 and sc.neighbourhood(edges, "H", 2).count() == 2
    for bad in (lambda: sc.neighbourhood(edges, "Z"), lambda: sc.neighbourhood(edges, "H", 3), lambda: sc.search_terms(edges, "zz"), lambda: sc.search_terms(edges, "a", "x")):
        with pytest.raises(ValueError):
            bad()
    assert sc.search_terms(edges, "LIT").count() == 1 and sc.class_has_property(edges, "C", "name") and not sc.class_has_property(edges, "C", "x")


def test_schema_edges_from_triples(spark):
    rows = [("a", "rdf:type", "A", "uri"), ("b", "rdf:type", "B", "uri"), ("b", "rdf:type", "B2", "uri"), ("a", "to", "b", "uri"), ("a", "to", "x", "uri"), ("a", "name", "n", "literal"), ("q", "to", "b", "uri")]
    t = spark.createDataFrame([(*r, None, None) for r in rows], readers.TRIPLES)
    got = sorted(map(tuple, sc.schema_edges(t).collect()))
    assert got == [("A", "name", "Literal"), ("A", "to", "B"), ("A", "to", "B2")]
    assert sc.schema_edges(t, 0).count() == 2 and sc.schema_edges(t, min_edges=3).count() == 2
    assert sorted(r.target_type for r in sc.schema_edges(t, 2).collect()) == ["B", "B2", "Literal_1"]
    assert sc.schema_edges(t.where("false")).count() == 0


def test_search_by_levels_equals_full_enumeration(spark):
    rng = random.Random(12)
    rows = {(rng.choice("ABCDEFG"), rng.choice(["p", "q", "pq", "r"]), rng.choice("ABCDEFG")) for _ in range(45)}
    edges = spark.createDataFrame(sorted(rows), "source_type string, edge string, target_type string")
    whole = sc.simple_paths(edges, "A", "G", 5).cache()
    for k in (1, 2, 5):
        expected = {(str(r.path), r.size, r.last) for r in sc.reduce_paths(whole, k).collect()}
        assert {(str(r.path), r.size, r.last) for r in sc.shortest_by_property(edges, "A", "G", k, 5).collect()} == expected
    expected = [(str(r.path), r.size) for r in whole.orderBy("size", sc._path_key()).limit(7).collect()]
    assert [(str(r.path), r.size) for r in sc.k_shortest_paths(edges, "A", "G", 7, 5).collect()] == expected
    assert sc.shortest_by_property(edges, "A", "A").isEmpty() and sc.shortest_by_property(edges, "A", "nowhere").isEmpty()


def test_dense_schema_in_bounded_rows(spark):
    """89 classes and 290 properties at depth 6: of some ten million paths and more only the open ones are followed."""
    i = F.col("id")
    rows = spark.range(7000).select(
        F.format_string("C%02d", F.pmod(F.hash(i), F.lit(89))).alias("source_type"), F.format_string("p%03d", F.pmod(F.hash(i, F.lit(1)), F.lit(290))).alias("edge"),
        F.format_string("C%02d", F.pmod(F.hash(i, F.lit(2)), F.lit(89))).alias("target_type"),
    )
    levels = []
    found = sc.shortest_by_property(rows, "C00", "C01", 5, 6, lambda size, n: levels.append(n))
    last = rows.where("target_type = 'C01' AND source_type != 'C01'").select("edge").distinct().count()
    assert {r["count"] for r in found.groupBy("last").count().collect()} == {5}
    assert found.select("last").distinct().count() == last
    assert sum(levels) < 100_000
    short = sc.reduce_paths(sc.simple_paths(rows, "C00", "C01", 4), 5)
    if found.agg(F.max("size")).first()[0] <= 3:
        assert {(str(r.path), r.last) for r in found.collect()} == {(str(r.path), r.last) for r in short.collect()}


def test_accuracy(spark):
    def cells(rows):
        return spark.createDataFrame([(q, i, c, v) for i, (q, c, v) in enumerate(rows)], "question_id int, row_id int, col string, value string")

    expected = cells([(1, "u", "http://a"), (1, "u", "plain"), (1, "n", "x"), (2, "n", "y"), (3, "n", "z"), (5, "n", None)])
    produced = cells([(1, "u", "http://a"), (1, "u", "http://b"), (1, "n", "q"), (2, "n", "y"), (2, "n", "w"), (4, "n", "")])
    got = dict(map(tuple, ev.answer_accuracy(expected, produced).collect()))
    assert got == {1: 0.5, 2: 0.5, 3: 0.0, 4: 1.0, 5: 1.0}


def test_workflow_drift(spark):
    cases = {
        "exact": (["a", "b", "c"], [("a", 1), ("b", 1), ("c", 1)], 0),
        "explored": (["a", "b"], [("get_usage_guide", 1), ("a", 1), ("find_candidate_entities", 0), ("b", 1)], 0),
        "never started": (["a", "b", "c"], [("b", 1), ("b", 1), ("a", 0), ("c", 1)], 3),
        "before start": (["a", "b"], [("b", 1), ("a", 1), ("b", 1)], 1),
        "extra": (["a", "b"], [("a", 1), ("x", 1), ("b", 1)], 1),
        "missing": (["a", "b", "c"], [("a", 1), ("b", 1)], 1),
        "swapped": (["a", "b", "c"], [("a", 1), ("c", 1), ("b", 1)], 0),
        "swapped and failed": (["a", "b", "c"], [("a", 1), ("c", 0), ("b", 1), ("c", 1)], 1),
        "retried in order": (["a", "b"], [("a", 1), ("b", 0), ("b", 1)], 0),
        "started again": (["a", "b"], [("a", 1), ("b", 1), ("a", 1)], 1),
        "no calls": (["a", "b"], [], 2),
        "no steps": ([], [("a", 1)], 0),
    }
    calls = [(k, i, n, "success" if ok else "error", "") for k, (_, cs, _) in cases.items() for i, (n, ok) in enumerate(cs)]
    flows = spark.createDataFrame([(k, [f"{s}(x=1)" for s in v[0]]) for k, v in cases.items()], "trace_id string, steps array<string>")
    got = dict(map(tuple, ev.workflow_drift(spark.createDataFrame(calls, "trace_id string, seq int, name string, status string, content string"), flows).collect()))
    assert got == {k: v[2] for k, v in cases.items()}


def plain_drift(steps, calls):
    started, open_, errors = False, list(range(len(steps))), 0
    for name, ok in calls:
        if ok and name == steps[0]:
            started, open_ = True, list(range(1, len(steps)))
            continue
        fitting = [i for i in open_ if steps[i] == name]
        if not started or not fitting or (not ok and fitting[0] != open_[0]):
            errors += 1
        if started and ok and fitting:
            open_.remove(fitting[0])
    return errors + len(open_) if started else len(steps)


def test_workflow_drift_in_chunks_equals_a_fold(spark):
    rng = random.Random(8)
    cases = {}
    for k in range(120):
        steps = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
        cases[f"t{k}"] = (steps, [(rng.choice("abcdx"), rng.random() < 0.7) for _ in range(rng.randrange(0, 40))])
    calls = [(k, i, n, "success" if ok else "error", "") for k, (_, cs) in cases.items() for i, (n, ok) in enumerate(cs)]
    flows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "trace_id string, steps array<string>")
    table = spark.createDataFrame(calls, "trace_id string, seq int, name string, status string, content string").repartition(5)
    expected = {k: plain_drift(*v) for k, v in cases.items()}
    for chunk in (1, 3, 1000):
        assert dict(map(tuple, ev.workflow_drift(table, flows, chunk).collect())) == expected


def test_workflow_drift_of_one_long_trace(spark):
    name = F.element_at(F.array(*map(F.lit, "abcx")), (F.pmod(F.hash("id"), F.lit(4)) + 1).cast("int"))
    ok = F.pmod(F.hash("id", F.lit(1)), F.lit(10)) > 2
    calls = spark.range(200_000).select(F.lit("long").alias("trace_id"), F.col("id").alias("seq"), name.alias("name"), F.when(ok, "success").otherwise("error").alias("status"), F.lit("").alias("content"))
    flows = spark.createDataFrame([("long", ["a", "b", "c", "b"])], "trace_id string, steps array<string>")
    rows = [(r.name, r.status == "success") for r in calls.orderBy("seq").collect()]
    assert [tuple(r) for r in ev.workflow_drift(calls, flows).collect()] == [("long", plain_drift(["a", "b", "c", "b"], rows))]
    cut = calls.repartitionByRange(4, "trace_id", "seq").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(cut) == 4 and max(r["count"] for r in cut) < 100_000


def test_consistency_within_bounds(spark):
    runs = [("m", q, a, 10, 1.0, 2, 0, 1, None) for q, a in ((1, 0.0), (1, 1.0), (2, 1.0), (2, 1.0))]
    schema = "config string, question int, accuracy double, tokens long, latency double, n_tools int, type_1 int, type_2 int, type_3 int"
    r = ev.compare_configurations(spark.createDataFrame(runs, schema)).first()
    assert (r.accuracy, r.consistency, r.tokens_per_pass, r.type_3) == (0.75, 0.5, 20.0, None)


def test_hops_and_difficulty(spark):
    q = 'SELECT ?x # no\n# a . comment\nWHERE { ?x a <http://a/b.c> ; p:b / p:c "x.y\\"." . FILTER(?a < (1.5)) }'
    d = spark.createDataFrame([(q, "easy"), (q, "Impossible"), ("SELECT (COUNT(?x)) { ?x a ?y . }", None), ("{" + " . " * 6 + "}", None), ("no braces .", None)], "q string, s string")
    assert [tuple(r) for r in d.select(ev.count_hops(F.col("q")), ev.query_difficulty(F.col("q"), F.col("s"))).collect()] == [(3, "easy"), (3, "impossible"), (1, "hard"), (6, "medium"), (1, "easy")]


def plain_hops(body):
    """Hops of a text without braces: pairs of parentheses are taken away until none is left."""
    body = re.sub(r"(?m)^#.*\n?", "", body)
    body = re.sub(r"<[^>]*>", " ", re.sub(r'"[^"\\]*(?:\\[^\n][^"\\]*)*"', " ", body))
    before = None
    while before != body:
        before, body = body, re.sub(r"\([^()]*\)", " ", body)
    return len(re.findall("[./;,]", body))


def test_hops_outside_parentheses_at_any_depth(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("()()()./;,a ", k=rng.randint(0, 40))) for _ in range(400)]
    texts += [". " + "(" * 40 + " . ; " + ", )" * 40 + " /", "(" * 500 + ".", "." + ")" * 500 + ".", "(.(.)", ")(.", "().)."]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    assert {r[0]: r[1] for r in d.select("i", ev.count_hops(F.col("q"))).collect()} == {i: plain_hops(t) for i, t in enumerate(texts)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_difficulty_of_all_documents(spark):
    data = "/root/testdata/sf0.01"
    want = Counter()
    for lang, text in spark.read.parquet(f"{data}/documents.parquet").select("lang", "text").collect():
        text = (text or "").replace("{", " ").replace("}", " ")
        n, special = plain_hops(text), re.search(r"\b(GROUP BY|COUNT|ORDER BY)\b", text.upper(), re.ASCII)
        want[lang, "hard" if special or n > 13 else "medium" if n > 5 else "easy"] += 1
    for name in ("v18_v20_all_documents", "v18_v20_query_difficulty"):
        got = {(r.lang, r.split): r["count"] for r in catalog.QUERIES[name](spark, data).collect()}
        assert got == want


def test_questions(spark):
    d = [{"messages": [{"content": "a"}, {"content": "b"}]}, {"input": "c"}, {"question": "d"}, {"inputs": {"query_input": "e"}}, {"z": 1}]
    got = spark.createDataFrame([(json.dumps(x),) for x in d], "i string").select(ev.question_text(F.col("i"))).collect()
    assert [r[0] for r in got] == ["b", "c", "d", "e", "Unknown"]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,p,b\nx,y\nc,q,d,more\n\n")
    assert sorted(map(tuple, readers.read_edge_list(spark, str(tmp_path / "e.csv")).collect())) == [("a", "p", "b"), ("c", "q", "d")]
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "1.rq").write_text('# category: "X"\n# split: "easy"\n# origin: user\n# question: "Which ?"\n# query:\nSELECT *\nWHERE { ?a ?b ?c }\n\n# workflow\nfirst(a="b")\n\nsecond()\n')
    (corpus / "2.rq").write_text("# question: none\n")
    r = readers.read_query_corpus(spark, str(corpus)).collect()
    assert [(x.category, x.split, x.origin, x.question, x.query, x.workflow) for x in r] == [("X", "easy", "user", "Which ?", "SELECT *\nWHERE { ?a ?b ?c }", ['first(a="b")', "second()"])]
    t = spark.createDataFrame([("a", "p", "1836", "literal", "gYear", ""), ("a", "q", "b", "uri", None, None)], readers.TRIPLES)
    readers.write_triples(t, str(tmp_path / "t"))
    back = readers.read_triples(spark, str(tmp_path / "t"), typed=True)
    assert back.count() == 2 and str(back.where("p = 'p'").first().o_last_day) == "1836-12-31"
    counts = spark.createDataFrame([("p", 3)], readers.EDGE_STATS)
    readers.write_csv(counts, str(tmp_path / "c"))
    readers.write_csv(counts, str(tmp_path / "c"), append=True)
    assert spark.read.schema(readers.EDGE_STATS).option("header", True).csv(str(tmp_path / "c")).count() == 2
    run = {"run_id": "1", "question": "q", "difficulty": "easy", "output": {"generated_query": "Q"}, "metrics": {"accuracy": 0.5}, "tools": [{"name": "n", "input": "i", "success": False}]}
    (tmp_path / "r.json").write_text(json.dumps([run]))
    runs = readers.read_runs(spark, str(tmp_path / "r.json"))
    assert readers.run_report(runs).first()[0].startswith("question: q\n- n(i) ERROR\nquery:\nQ\naccuracy: 0.5   llm: 0.0\n---")
    readers.write_runs(runs, str(tmp_path / "out"))
    assert readers.read_runs(spark, str(tmp_path / "out"), multi_line=False).first().run_id == "1"
    b = spark.createDataFrame([('{"x": {"type": "uri", "value": "v", "xml:lang": "en"}}',), (None,)], "row string")
    assert [r[0] for r in readers.flat_bindings(b, "row").collect()] == [{"x": "v"}, None]


def test_schema_edges_of_rows_equal_those_of_triples_and_are_read_once(spark):
    view = triples(spark, "/root/testdata/sf0.001")
    plain = view.where("true")
    got = sc.schema_edges(view)
    assert not hasattr(plain, "by_subject") and sorted(got.collect()) == sorted(sc.schema_edges(plain).collect())
    # What follows reads the schema, and no table of triples again.
    assert all("graphloom-" in f for f in got.inputFiles())


def test_corpus_of_many_records_a_file_equals_a_file_each(spark, tmp_path):
    rows = [(i, f"# category: easy\n# question: q{i} ?\n# query:\nSELECT {i}\n\n# workflow\nfind({i})\nrun()") for i in range(5)] + [(9, "no record")]
    table = spark.createDataFrame(rows, "i int, value string")
    table.repartition("i").write.partitionBy("i").text(str(tmp_path / "each"))
    table.select("value").coalesce(1).write.text(str(tmp_path / "many"), lineSep="\x1e")
    each, many = (df.drop("file_path").collect() for df in (readers.read_query_corpus(spark, str(tmp_path / "each/*")), readers.read_query_corpus(spark, str(tmp_path / "many"), "\x1e")))
    assert sorted(map(str, each)) == sorted(map(str, many)) and len(many) == 5


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_query_corpus_writes_no_file_a_record(spark):
    got = catalog.QUERIES["s05_query_corpus"](spark, "/root/testdata/sf0.01")
    assert got.count() == 100 > 10 * len(got.inputFiles())
