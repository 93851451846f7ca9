"""Patterns, aggregates, entities and entity plans on hand-made triples."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import aggregate as agg
from graphloom.operators import entities as en
from graphloom.operators import pattern as pt
from graphloom.plans import entities as plans
from graphloom.sources import readers

U, L = "uri", "literal"


def _rows():
    def uri(s, p, o):
        return (s, p, o, U, None, None)

    def text(s, p, o, lang="", kind="string"):
        return (s, p, o, L, kind, lang)

    work, made = "efrbroo:F22_Self-Contained_Expression", "efrbroo:R17_created"
    return [
        uri("w1", "rdf:type", work), text("w1", "rdfs:label", "Bolero", "en"), text("w1", "rdfs:label", "Boléro", "fr"), uri("c1", made, "w1"),
        uri("w2", "rdf:type", work), uri("c2", made, "w2"),
        uri("w3", "rdf:type", work), text("w3", "rdfs:label", "Le Bolero bleu", "fr"), uri("c3", made, "w3"),
        uri("c1", "ecrm:P9_consists_of", "a1"), uri("a1", "ecrm:P14_carried_out_by", "ravel"), uri("a1", "mus:U31_had_function", "function/composer"),
        uri("c3", "ecrm:P9_consists_of", "a3"), uri("a3", "ecrm:P14_carried_out_by", "satie"), uri("a3", "mus:U31_had_function", "function/librettist"),
        text("ravel", "foaf:name", "Maurice Ravel"), text("satie", "foaf:name", "Erik Satie"), uri("ravel", "rdf:type", "ecrm:E21_Person"),
        text("ravel", "rdfs:comment", "a composer", "en"), text("ravel", "rdfs:comment", "ein Komponist", "de"),
        uri("c1", "timeSpan", "t1"), uri("t1", "time:hasBeginning", "b1"), uri("t1", "time:hasEnd", "e1"),
        text("b1", "time:inXSDDate", "1928", kind="gYear"), text("e1", "time:inXSDDate", "1928-11-22", kind="date"),
        uri("c3", "timeSpan", "t3"), uri("t3", "time:hasBeginning", "b3"), text("b3", "time:inXSDDate", "1930"),
        uri("k1", "detail", "d1"), uri("k1", "detail", "d2"), uri("k2", "detail", "d3"), text("d1", "qty", "2", kind="integer"), text("d2", "qty", "one"),
        uri("u1", "skos:exactMatch", "u2"), uri("u2", "skos:exactMatch", "u3"), uri("u3", "owl:sameAs", "u1"),
        uri("v1", "skos:broader", "v2"), uri("v2", "skos:broader", "v3"),
        text("x1", "lasts", "PT1H", kind="duration"), text("x2", "lasts", "PT59M"), text("x3", "lasts", "P1Y"), text("x4", "lasts", "abc"),
    ]


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(_rows(), readers.TRIPLES).cache()


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


def test_match_forms(t):
    assert rows(pt.match(t, "?w", "rdf:type", "efrbroo:F22_Self-Contained_Expression")) == [("w1",), ("w2",), ("w3",)]
    assert rows(pt.match(t, "w1", "?p", "Bolero")) == [("rdfs:label",)]
    assert rows(pt.match(t, "?w", "^efrbroo:R17_created", "c1")) == [("w1",)]
    assert rows(pt.match(t, "?a", ["skos:exactMatch", "owl:sameAs"], "?b")) == [("u1", "u2"), ("u2", "u3"), ("u3", "u1")]
    assert rows(pt.match(t, "?a", "skos:exactMatch", "?a")) == []
    with pytest.raises(ValueError):
        pt.match(t, "a", "b", "c")


def test_join_needs_a_shared_variable(t):
    a, b = pt.match(t, "?a", "detail", "?d"), pt.match(t, "?d", "qty", "?q")
    assert rows(pt.conjunction(a, b), "a", "q") == [("k1", "2"), ("k1", "one")]
    with pytest.raises(ValueError):
        pt.conjunction(a, b.withColumnRenamed("d", "e"))


def test_path_and_closure_on_a_cycle(spark, t):
    assert rows(pt.path(t, "?w", ["^efrbroo:R17_created", "ecrm:P9_consists_of", "ecrm:P14_carried_out_by"], "?who")) == [("w1", "ravel"), ("w3", "satie")]
    starts = spark.createDataFrame([("u1",), ("v1",), ("lone",), (None,)], "x string")
    edges = pt.match(t, "?s", ["skos:exactMatch", "owl:sameAs", "skos:broader"], "?o")
    want = [("lone", "lone"), ("u1", "u1"), ("u1", "u2"), ("u1", "u3"), ("v1", "v1"), ("v1", "v2"), ("v1", "v3")]
    assert rows(pt.closure(edges, starts)) == want
    assert ("v1", "v3") not in rows(pt.closure(edges, starts, max_rounds=1))


def test_values_few_many_none(t):
    found = pt.match(t, "?a", "detail", "?d")
    assert rows(pt.values(found, "d", ["d1", "d1", "zz"])) == [("k1", "d1")]
    assert rows(pt.values(found, "d", ["d3", *map(str, range(2000))])) == [("k2", "d3")]
    assert rows(pt.values(found, "d", [])) == []


def test_filters_on_numbers_and_durations(t):
    quantities, lasts = pt.match(t, "?d", "qty", "?q"), pt.match(t, "?x", "lasts", "?v")
    assert rows(quantities.where(pt.number_filter("q", "equal", 2)), "d") == [("d1",)]
    assert rows(lasts.where(pt.duration_filter("v", "less", "PT1H")), "x") == [("x1",), ("x2",)]
    assert rows(lasts.where(pt.duration_filter("v", "range", "PT59M1S", "PT2H")), "x") == [("x1",)]
    for bad in (lambda: pt.number_filter("q", "near", 1), lambda: pt.number_filter("q", "range", 1), lambda: pt.open_span("q", "equal", "1900")):
        with pytest.raises(ValueError):
            bad()


def test_spans(t):
    creations = pt.match(t, "?c", "timeSpan", "?s")

    def asked(operator, start, end=None):
        return rows(plans.filter_by_quantity(creations.select("c"), t, "c", "timeSpan", operator, start, end), "c")

    assert asked("range", "1928", "1928") == [("c1",)]
    assert asked("range", "1930", "1931") == [("c3",)]  # only its beginning is known
    assert asked("equal", "1928-06-01") == [("c1",)]
    assert asked("more", "1928") == [("c3",)] and asked("less", "1930") == [("c1",)]


def test_outer_and_anti_joins_with_nulls(spark):
    left = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, n int")
    right = spark.createDataFrame([(1,), (None,)], "n int")
    assert [r.k for r in pt.minus(left, right).orderBy("k").collect()] == ["b", "c"]
    assert pt.minus(left, right.withColumnRenamed("n", "m")).count() == 3
    assert [r.k for r in pt.exists(left, right.union(right)).collect()] == ["a"]
    assert pt.not_exists(left, right).count() == 2
    assert pt.optional(left, right.withColumn("hit", F.lit(1))).where("hit IS NULL").count() == 2
    assert pt.union(left, right).where("k IS NULL").count() == 2


def test_members_and_pairs(spark):
    m = spark.createDataFrame([("g", "x", 1), ("g", "y", 1), ("g", "x", 1), ("h", "x", 1), ("h", "z", 2)], "g string, m string, v int")
    assert rows(pt.exactly_members(m, "g", "m", ["y", "x"])) == [("g",)]
    assert rows(pt.exactly_members(m, "g", "m", ["x"])) == []
    assert rows(pt.pairs_in_group(m, "g", "m", "v")) == [("g", 1, "x", "y")]


def test_language_filter(t):
    assert pt.language_filter(t.where("p = 'rdfs:comment'")).count() == 1


def test_aggregates_and_having(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "x"), ("b", "4"), ("b", None)], "k string, v string")
    out = agg.group_by(d, ["k"], {f: agg.aggregate(f, "v") for f in agg.AGGREGATORS}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [("a", 2, 2.0, 1.0, "1", "x", "1"), ("b", 1, 4.0, 4.0, "4", "4", "4")]
    n = agg.group_by(d, ["k"], {"n": agg.aggregate("COUNT", "v", distinct=False)})
    assert rows(agg.having(n, "n", "more", 1)) == [("a", 3)] and rows(agg.having(n, "n", "range", 1, 1)) == [("b", 1)]
    assert agg.group_by(d.where("false"), [], {"n": F.count("*")}).first().n == 0
    with pytest.raises(ValueError):
        agg.aggregate("MEDIAN", "v")


def test_labels_and_pages(spark, t):
    assert dict(rows(en.labels_of(t)))["w1"] == "Bolero"
    assert dict(rows(agg.heaviest_label(pt.match(t, "?s", "rdfs:label", "?o").join(t.select("s", "o", "o_lang"), ["s", "o"]), ["s"], "o", "o_lang")))["w3"] == "Le Bolero bleu"
    few, total = agg.page(spark.range(250), "id")
    assert few.count() == 10 and total == "100+"
    assert agg.page(spark.range(7), "id", 3)[1] == "7"


def test_search(t):
    found = en.candidates(t, "bolero").collect()
    assert [(r.entity, r.label) for r in found] == [("w1", "Bolero"), ("w3", "Le Bolero bleu")] and found[0].score == 1.0
    assert en.candidates_or_any(t, "bolero", "artist").count() == 2
    for bad in (lambda: en.candidates(t, " "), lambda: en.candidates(t, "x", "planet")):
        with pytest.raises(ValueError):
            bad()


def test_resolve_and_profile(spark, t):
    names = spark.createDataFrame([("bolero",), ("",), ("zzz",), (None,)], "name string")
    assert [(r.name, r.entity) for r in en.resolve(t, names).orderBy("name").collect()] == [("bolero", "w1"), ("zzz", None)]
    p = en.profile(t, spark.createDataFrame([("ravel",)], "s string")).collect()
    assert [(r.p, [tuple(o) for o in r.objects]) for r in p] == [("rdfs:comment", [("a composer", None)])] and p[0].type == "ecrm:E21_Person"


def test_equivalents(spark, t):
    one = spark.createDataFrame([("u2",), ("w1",)], "x string")
    found = en.equivalents(t, one)
    assert rows(found) == [("u2", "u1"), ("u2", "u2"), ("u2", "u3"), ("w1", "w1")]
    assert rows(en.preferred_equivalents(found, "u3")) == [("u2", "u3"), ("w1", "w1")]
    assert rows(en.expand_restriction(t, one, "u")) == [("u1",), ("u2",), ("u3",), ("w1",)]
    assert rows(en.unknown_uris(t, ["u1", "u9", "http://x"], "u")) == [("u9",)]


def test_entity_plans(t):
    works = plans.build_query(t, "expression")
    assert rows(pt.project(works, "expression")) == [("w1",), ("w3",)]
    assert rows(pt.project(plans.apply_filter(works, t, "expression", "composer_name", text="ravel"), "expression")) == [("w1",)]
    assert rows(pt.project(plans.apply_filter(works, t, "expression", "composer_name", uris=["satie"]), "expression")) == []
    assert sum(len(k.filters) for k in plans.KINDS.values()) == 21
    for bad in (lambda: plans.build_query(t, "opera"), lambda: plans.apply_filter(works, t, "expression", "title", uris=["x"]), lambda: plans.apply_filter(works, t, "expression", "size")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        plans.ensure_not_empty(works.where("false"))


def two_worlds(kind, filter_):
    """Triples that fulfil the core and the filter twice over, for entities whose nodes end in 1 and in 2; a third has no filter."""
    out = set()
    for k in (1, 2, 3):
        def node(term, k=k):
            return "function/composer" if term == plans.COMPOSER else f"{term[1:]}{k}" if term.startswith("?") else term

        for s, p, o in (*kind.core, *(filter_.patterns if k < 3 else ())):
            steps = p if isinstance(p, tuple) else (p,)
            nodes = [node(s), *(f"{node(s)}_{step}_{node(o)}" for step in steps[:-1]), node(o)]
            out |= set(zip(nodes, steps, nodes[1:], strict=False))
    return sorted(out)


KIND_FILTERS = [(name, f) for name, kind in plans.KINDS.items() for f in kind.filters]


def test_every_filter_of_every_kind_gives_its_rows(spark):
    worlds = [(f"{name}.{f}", *t) for name, f in KIND_FILTERS for t in two_worlds(plans.KINDS[name], plans.KINDS[name].filters[f])]
    every = spark.createDataFrame(worlds, "world string, s string, p string, o string").cache()
    got, want = [], []

    def ask(name, f, way, **restriction):
        kind = plans.KINDS[name]
        t = every.where(F.col("world") == f"{name}.{f}").drop("world")
        query = plans.apply_filter(plans.build_query(t, name), t, name, f, **restriction)
        assert kind.label in query.columns and kind.filters[f].text in query.columns
        got.append(query.select(F.lit(f"{name}.{f}.{way}").alias("asked"), F.col(kind.var).alias("entity")).distinct())

    for name, f in KIND_FILTERS:
        kind, spec = plans.KINDS[name], plans.KINDS[name].filters[f]
        ask(name, f, "text", text=f"^{spec.text}2$".upper())
        want.append((f"{name}.{f}.text", f"{kind.var}2"))
        if spec.uri:
            ask(name, f, "uri", uris=[f"{spec.uri}1"])
            want.append((f"{name}.{f}.uri", f"{kind.var}1"))
        ask(name, f, "bind")
        core = all(p in kind.core for p in spec.patterns)
        want += [(f"{name}.{f}.bind", f"{kind.var}{k}") for k in ((1, 2, 3) if core else (1, 2))]
    # In parts: one plan of all would be large.
    found = [r for at in range(0, len(got), 12) for r in rows(reduce(DataFrame.unionByName, got[at : at + 12]))]
    assert sorted(found) == sorted(want)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    links = spark.createDataFrame([*chain, *((f"s{i}", "a") for i in range(9)), (None, "x"), ("b", "b")], "s string, o string")
    got = dict(map(tuple, pt.components(links).collect()))
    assert got == {f"c{i:02}": "c00" for i in range(21)} | {f"s{i}": "a" for i in range(9)} | {"a": "a", "b": "b"}
    assert pt.components(links.where("false")).count() == 0


def test_terms(spark):
    d = spark.createDataFrame([("1836",), ("31-12-1799",), ("1799-02-30",), ("1799-12-31",), ("x",), (None,)], "d string")
    got = [tuple(map(str, r)) for r in d.select(terms.first_day(F.col("d")), terms.last_day(F.col("d"))).collect()]
    assert got == [("1836-01-01", "1836-12-31"), ("1799-12-31",) * 2, ("None",) * 2, ("1799-12-31",) * 2, ("None",) * 2, ("None",) * 2]
    d = spark.createDataFrame([("PT1H",), ("P1DT2H3M4.5S",), ("P1Y",), ("P",), ("PT",), ("abc",)], "d string")
    assert [tuple(r) for r in d.select(terms.duration_seconds(F.col("d")), terms.is_duration(F.col("d"))).collect()] == [(3600.0, True), (93784.5, True), (None, True), (None, False), (None, False), (None, False)]
    d = spark.createDataFrame([("12",), ("1.5",), ("1.2.3",), ("-1",), (".",), ("",)], "d string")
    assert [r[0] for r in d.select(terms.is_plain_number(F.col("d"))).collect()] == [True, True, False, False, False, False]
    d = spark.createDataFrame([("<rdfs:label>", "http://erlangen-crm.org/efrbroo/R17"), ("a:b", "http://x/y#z")], "a string, b string")
    got = [tuple(r) for r in d.select(terms.expand(F.col("a")), terms.contract(F.col("b")), terms.contract_known(F.col("b")), terms.short_label(F.col("b"))).collect()]
    assert got == [("http://www.w3.org/2000/01/rdf-schema#label", "efrbroo:R17", "efrbroo:R17", "R17"), ("a:b", "http://x/y#z", None, "z")]


def test_pairs_of_a_large_group_in_blocks(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 850, "big").otherwise("small").alias("g"), F.format_string("m%03d", "id").alias("m"), (F.col("id") % 2).alias("v"))
    rows = rows.unionAll(rows.limit(50)).unionAll(spark.createDataFrame([("big", None, 1), (None, "x", 1), ("big", "y", None)], "g string, m string, v long"))
    whole = pt.pairs_in_group(rows, "g", "m", "v")
    assert whole.count() == 2 * (425 * 424 // 2 + 25 * 24 // 2)
    for block in (7, 100):
        cut = pt.pairs_in_group(rows, "g", "m", "v", block)
        assert cut.count() == whole.count() and cut.exceptAll(whole).isEmpty() and cut.where("a >= b").isEmpty()


def test_pairs_of_a_large_group_spread_over_tasks(spark):
    rows = spark.range(50_000).select(F.lit("g").alias("g"), F.col("id").alias("m"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # The join's left input by task: each of the 25 blocks lies in 25 cells.
        dealt = pt.pairs_in_group(rows, "g", "m", "v")
        side = dealt._jdf.queryExecution().optimizedPlan().toString()
        assert side.count("explode") == 2
        blocks = rows.select(F.pmod(F.xxhash64("m"), F.lit(25)).alias("b")).groupBy("b").count().collect()
        assert len(blocks) == 25 and max(r["count"] for r in blocks) < 1.1 * pt.BLOCK_MEMBERS
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_at_any_offset(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(5)
    assert [r.k for r in agg.rows_between(rows, [F.desc("k")], 700, 5).collect()] == [299, 298, 297, 296, 295]
    assert agg.rows_between(rows, ["k"], 1000, 5).isEmpty()
    assert "WindowExec" not in agg.mask_uris(rows, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_pairs_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(pt, "TASK_ROWS", 500)
    members = spark.range(10_000).select((F.col("id") % 2000).alias("g"), F.col("id").alias("m"), F.lit(1).alias("v"))
    pairs = pt.pairs_in_group(members, "g", "m", "v")
    assert pairs.count() == 2000 * 10
    assert pt.tasks_for(spark, 10_000) == 20 and pairs._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert pt.tasks_for(spark, 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
