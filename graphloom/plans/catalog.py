"""Registered queries over the triples view of the driver's tables, and the same questions in relational SQL.

Every entry is (query, SQL): the query takes (spark, sf_dir); SQL is None where order or state defies it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import aggregate as agg
from graphloom.operators import entities as en
from graphloom.operators import evaluation as ev
from graphloom.operators import pattern as pt
from graphloom.operators import schema as sc
from graphloom.operators.numbering import numbered, written
from graphloom.plans import entities as plans
from graphloom.sources import readers
from graphloom.sources.relational import triples
from graphloom.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def _register(name: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a query over the triples view."""

    def add(query: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        CATALOG[name] = (lambda spark, sf_dir: query(triples(spark, sf_dir)), sql)
        return query

    return add


def _register_tables(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers a query over the tables themselves."""

    def add(query: Query) -> Query:
        CATALOG[name] = (query, sql)
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The whole view for SQL: class, table, subject, label, and the column of each predicate (triples need one that is not null).
_CLASSES = (
    ("Order", "orders", "'order/' || o_orderkey", None,
     (("rdf:type", "*"), ("placedBy", "o_custkey"), ("date", "o_orderdate"), ("total", "o_totalprice"), ("status", "o_orderstatus"), ("priority", "o_orderpriority"))),
    ("Customer", "customer", "'customer/' || c_custkey", "c_name",
     (("rdf:type", "*"), ("rdfs:label", "c_name"), ("inNation", "c_nationkey"), ("segment", "c_mktsegment"), ("balance", "c_acctbal"))),
    ("Supplier", "supplier", "'supplier/' || s_suppkey", "s_name",
     (("rdf:type", "*"), ("rdfs:label", "s_name"), ("inNation", "s_nationkey"), ("balance", "s_acctbal"))),
    ("Nation", "nation", "'nation/' || n_nationkey", "n_name",
     (("rdf:type", "*"), ("rdfs:label", "n_name"), ("skos:broader", "n_regionkey"), ("linkedTo", "n_nationkey"))),
    ("Region", "region", "'region/' || r_regionkey", "r_name", (("rdf:type", "*"), ("rdfs:label", "r_name"), ("skos:broader", "*"))),
    ("Part", "part", "'part/' || p_partkey", "p_name",
     (("rdf:type", "*"), ("rdfs:label", "p_name"), ("brand", "p_brand"), ("partType", "p_type"), ("size", "p_size"), ("price", "p_retailprice"))),
    ("Line", "lineitem", "'line'", None,
     (("rdf:type", "*"), ("ofOrder", "l_orderkey"), ("ofPart", "l_partkey"), ("bySupplier", "l_suppkey"), ("quantity", "l_quantity"), ("shipDate", "l_shipdate"))),
    ("Document", "documents", "'document/' || doc_id", None, (("rdf:type", "*"), ("lang", "lang"), ("source", "source"), ("text", "text"))),
)

# Kinds of entity over the driver's tables.
CUSTOMER = plans.Entity(
    "customer", "name",
    (("?customer", pt.TYPE, "Customer"), ("?customer", "rdfs:label", "?name")),
    {
        "nation": plans.Filter((("?customer", "inNation", "?nation"), ("?nation", "rdfs:label", "?nationName")), "nation", "nationName"),
        "segment": plans.Filter((("?customer", "segment", "?segment"),), "segment", "segment"),
        "order": plans.Filter((("?order", "placedBy", "?customer"), ("?order", "status", "?status")), None, "status"),
    },
)


# Patterns.


@_register("p01_triple_pattern", "SELECT 'order/' || o_orderkey AS \"order\" FROM orders WHERE o_orderstatus = 'F'")
def _(t: DataFrame) -> DataFrame:
    return pt.match(t, "?order", "status", "F")


@_register("p02_class_scan", "SELECT 'supplier/' || s_suppkey AS supplier FROM supplier")
def _(t: DataFrame) -> DataFrame:
    return pt.instances(t, "?supplier", "Supplier")


@_register(
    "p03_conjunction",
    """SELECT 'order/' || o_orderkey AS "order", c_name AS name, n_name AS nation FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'""",
)
def _(t: DataFrame) -> DataFrame:
    nation = pt.match(t, "?n", "rdfs:label", "?nation").where("nation = 'NATION_3'")
    found = pt.conjunction(nation, pt.match(t, "?c", "inNation", "?n"), pt.match(t, "?c", "rdfs:label", "?name"), pt.match(t, "?order", "placedBy", "?c"))
    return pt.project(found, "order", "name", "nation")


@_register(
    "p04_cycle",
    """SELECT DISTINCT 'order/' || o_orderkey AS "order", 'supplier/' || s_suppkey AS supplier FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey""",
)
def _(t: DataFrame) -> DataFrame:
    buyer = pt.path(t, "?order", ["placedBy", "inNation"], "?nation")
    line = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "bySupplier", "?supplier"))
    found = pt.conjunction(line, buyer, pt.match(t, "?supplier", "inNation", "?nation"))
    return pt.project(pt.without(found, "line", "nation"), "order", "supplier")


@_register(
    "p06_all_properties",
    """SELECT 'inNation' AS property, 'nation/' || c_nationkey AS value FROM customer WHERE c_custkey = 7
       UNION ALL SELECT 'rdf:type', 'Customer' FROM customer WHERE c_custkey = 7
       UNION ALL SELECT 'rdfs:label', c_name FROM customer WHERE c_custkey = 7
       UNION ALL SELECT 'segment', 'segment/' || c_mktsegment FROM customer WHERE c_custkey = 7
       UNION ALL SELECT 'balance', c_acctbal::DOUBLE::VARCHAR FROM customer WHERE c_custkey = 7""",
)
def _(t: DataFrame) -> DataFrame:
    return pt.match(t, "customer/7", "?property", "?value")


@_register(
    "p07_sequence_path",
    """SELECT 'customer/' || c_custkey AS customer, 'region/' || n_regionkey AS region FROM customer
       JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: DataFrame) -> DataFrame:
    return pt.exists(pt.path(t, "?customer", ["inNation", "skos:broader"], "?region"), pt.instances(t, "?customer", "Customer"))


@_register(
    "p08_alternative_path",
    """SELECT 'part/' || p_partkey AS part, p_brand AS value FROM part
       UNION ALL SELECT 'part/' || p_partkey, p_type FROM part""",
)
def _(t: DataFrame) -> DataFrame:
    return pt.match(t, "?part", ["brand", "partType"], "?value")


@_register(
    "p09_inverse_path", "SELECT DISTINCT 'customer/' || o_custkey AS customer, 'order/' || o_orderkey AS \"order\" FROM orders"
)
def _(t: DataFrame) -> DataFrame:
    return pt.project(pt.match(t, "?customer", "^placedBy", "?order"))


@_register(
    "p10_closure",
    """WITH RECURSIVE e AS (SELECT 'nation/' || n_nationkey AS s, 'nation/' || ((7 * n_nationkey + 3) % 25) AS o FROM nation),
       r AS (SELECT s AS start, s AS node FROM e UNION SELECT r.start, e.o FROM r JOIN e ON e.s = r.node)
       SELECT start, node FROM r""",
)
def _(t: DataFrame) -> DataFrame:
    return pt.closure(pt.match(t, "?s", "linkedTo", "?o"), pt.instances(t, "?start", "Nation"))


@_register(
    "p10_broader_chain",
    """SELECT 'nation/' || n_nationkey AS start, unnest(['nation/' || n_nationkey, 'region/' || n_regionkey, 'world']) AS node FROM nation""",
)
def _(t: DataFrame) -> DataFrame:
    return pt.closure(pt.match(t, "?s", "skos:broader", "?o"), pt.instances(t, "?start", "Nation"))


@_register(
    "p11_values_few",
    "SELECT 'customer/' || c_custkey AS customer, 'nation/' || c_nationkey AS nation FROM customer WHERE c_nationkey IN (1, 2)",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.values(pt.match(t, "?customer", "inNation", "?nation"), "nation", ["nation/1", "nation/2", "nation/99"])
    return pt.exists(found, pt.instances(t, "?customer", "Customer"))


@_register(
    "p11_values_many",
    "SELECT 'order/' || o_orderkey AS \"order\", 'customer/' || o_custkey AS customer FROM orders WHERE o_custkey < 1100",
)
def _(t: DataFrame) -> DataFrame:
    return pt.values(pt.match(t, "?order", "placedBy", "?customer"), "customer", [f"customer/{i}" for i in range(1100)])


@_register(
    "p13_regex",
    "SELECT 'part/' || p_partkey AS part, p_name AS name FROM part WHERE regexp_matches(p_name, '^RED .*g', 'i')",
)
def _(t: DataFrame) -> DataFrame:
    return pt.all_of(pt.match(t, "?part", "rdfs:label", "?name"), pt.regex("name", "^red .*G"), F.col("part").startswith("part/"))


@_register("p14_contains", "SELECT 'part/' || p_partkey AS part, p_name AS name FROM part WHERE contains(p_name, 'ring')")
def _(t: DataFrame) -> DataFrame:
    parts = pt.exists(pt.match(t, "?part", "rdfs:label", "?name"), pt.instances(t, "?part", "Part"))
    return parts.where(pt.contains("name", "ring"))


@_register(
    "p15_number_range",
    "SELECT 'part/' || p_partkey AS part FROM part WHERE p_retailprice BETWEEN 905 AND 950 AND p_size >= 10",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "price", "?price"), pt.match(t, "?part", "size", "?size"))
    return pt.all_of(found, pt.number_filter("price", "range", 905, 950), pt.number_filter("size", "more", 10)).select("part")


@_register(
    "p16_inequality",
    """SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem AS a JOIN lineitem AS b USING (l_orderkey)
       WHERE a.l_suppkey <> b.l_suppkey""",
)
def _(t: DataFrame) -> DataFrame:
    """Suppliers that ship lines of one order: an order has few, so pairs grow with the lines."""
    ours = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "bySupplier", "?x")).select("order", "x").distinct()
    both = pt.conjunction(ours, ours.withColumnRenamed("x", "y")).where("x != y").select("x", "y").distinct()
    return both.select(*(F.split_part(x, F.lit("/"), F.lit(2)).cast("long").alias(y) for x, y in (("x", "a"), ("y", "b"))))


_SPANS_SQL = """SELECT 'order/' || o_orderkey AS "order", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "begin",
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS "end" FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _spans(t: DataFrame) -> DataFrame:
    """Order date and ship date of each line."""
    line = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "shipDate", "?end"))
    return pt.conjunction(line, pt.match(t, "?order", "date", "?begin")).select("order", "begin", "end")


@_register("p17_span_inside", f"SELECT DISTINCT * FROM ({_SPANS_SQL}) WHERE \"begin\" >= '1997-01-01' AND \"end\" <= '1998-12-31'")
def _(t: DataFrame) -> DataFrame:
    return _spans(t).where(pt.inside("begin", "end", "1997", "1998")).distinct()


@_register("p18_span_or_begin", f"SELECT DISTINCT * FROM ({_SPANS_SQL}) WHERE \"begin\" BETWEEN '1995-03-01' AND '1995-03-02'")
def _(t: DataFrame) -> DataFrame:
    endless = _spans(t).withColumn("last", F.lit("2999-01-01"))  # so that nothing is inside
    return pt.inside_or_begins(endless, "begin", "last", "1995-03-01", "1995-03-02").drop("last").distinct()


@_register("p19_point_in_span", f"SELECT DISTINCT * FROM ({_SPANS_SQL}) WHERE \"begin\" <= '1996-06-15' AND \"end\" >= '1996-06-15'")
def _(t: DataFrame) -> DataFrame:
    return _spans(t).where(pt.span_holds("begin", "end", "1996-06-15")).distinct()


@_register("p20_open_span", f"SELECT DISTINCT * FROM ({_SPANS_SQL}) WHERE \"begin\" > '1998-12-31'")
def _(t: DataFrame) -> DataFrame:
    return _spans(t).where(pt.open_span("begin", "more", "1998")).distinct()


@_register(
    "p21_duration",
    """SELECT 'order/' || l_orderkey AS "order", count(*) AS n FROM lineitem WHERE l_quantity * 60 <= 600 GROUP BY 1""",
)
def _(t: DataFrame) -> DataFrame:
    line = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "quantity", "?q"))
    timed = pt.bind(line, took=F.concat(F.lit("PT"), terms.number(F.col("q")).cast("int").cast("string"), F.lit("M")))
    return timed.where(pt.duration_filter("took", "less", "PT10M")).groupBy("order").agg(F.count("*").alias("n"))


@_register("p22_date", "SELECT 'order/' || o_orderkey AS \"order\" FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN '1996-01-01' AND '1996-12-31'")
def _(t: DataFrame) -> DataFrame:
    return pt.match(t, "?order", "date", "?date").where(pt.date_filter("date", "1996", "1996")).select("order")


@_register("p23_years_apart", f"SELECT DISTINCT * FROM ({_SPANS_SQL}) WHERE year(CAST(\"end\" AS DATE)) - year(CAST(\"begin\" AS DATE)) <= 0")
def _(t: DataFrame) -> DataFrame:
    return _spans(t).where(pt.years_apart("end", "begin", 0)).distinct()


@_register(
    "p24_language",
    """SELECT 'document/' || doc_id AS s, p FROM documents, (SELECT unnest(['rdf:type', 'lang', 'source', 'text']) AS p)
       WHERE p <> 'text' OR (lang = 'en' AND text IS NOT NULL)""",
)
def _(t: DataFrame) -> DataFrame:
    of = t.where(F.col("s").startswith("document/"))
    return pt.language_filter(of, ["text"]).select("s", "p")


@_register(
    "p25_optional",
    """SELECT 'customer/' || c_custkey AS customer, count(o_orderkey) AS orders FROM customer
       LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""",
)
def _(t: DataFrame) -> DataFrame:
    placed = pt.conjunction(pt.match(t, "?order", "status", "P"), pt.match(t, "?order", "placedBy", "?customer"))
    return pt.optional(pt.instances(t, "?customer", "Customer"), placed).groupBy("customer").agg(F.count("order").alias("orders"))


@_register(
    "p26_union",
    """SELECT 'customer/' || c_custkey AS who, 'segment/' || c_mktsegment AS segment FROM customer WHERE c_nationkey = 4
       UNION ALL SELECT 'supplier/' || s_suppkey, NULL FROM supplier WHERE s_nationkey = 4""",
)
def _(t: DataFrame) -> DataFrame:
    here = pt.match(t, "?who", "inNation", "nation/4")
    return pt.union(pt.conjunction(here, pt.match(t, "?who", "segment", "?segment")), pt.exists(here, pt.instances(t, "?who", "Supplier")))


@_register("p27_minus", "SELECT 'order/' || o_orderkey AS \"order\" FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t: DataFrame) -> DataFrame:
    return pt.minus(pt.instances(t, "?order", "Order"), pt.match(t, "?line", "ofOrder", "?order"))


@_register(
    "p28_not_exists",
    """SELECT 'customer/' || c_custkey AS customer FROM customer WHERE NOT EXISTS (
       SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
       WHERE o_custkey = c_custkey AND s_nationkey = c_nationkey)""",
)
def _(t: DataFrame) -> DataFrame:
    customers = pt.conjunction(pt.instances(t, "?customer", "Customer"), pt.match(t, "?customer", "inNation", "?nation"))
    line = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.path(t, "?line", ["bySupplier", "inNation"], "?nation"), pt.match(t, "?order", "placedBy", "?customer"))
    return pt.not_exists(customers, line).select("customer")


@_register("p29_exists", "SELECT 'part/' || p_partkey AS part FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def _(t: DataFrame) -> DataFrame:
    line = pt.conjunction(pt.match(t, "?line", "quantity", "?q").where(pt.number_filter("q", "more", 49)), pt.match(t, "?line", "ofPart", "?part"))
    return pt.exists(pt.instances(t, "?part", "Part"), line)


@_register(
    "p30_subselect",
    """SELECT 'customer/' || o_custkey AS customer, "n", count(*) AS large FROM orders
       JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) USING (o_custkey)
       WHERE o_totalprice >= 300000 GROUP BY o_custkey, n""",
)
def _(t: DataFrame) -> DataFrame:
    placed = pt.match(t, "?order", "placedBy", "?customer")
    busy = agg.having(agg.group_by(placed, ["customer"], {"n": agg.aggregate("COUNT", "order", distinct=False)}), "n", "more", 12)
    large = pt.match(t, "?order", "total", "?total").where(pt.number_filter("total", "more", 300000))
    return pt.conjunction(busy, placed, large).groupBy("customer", "n").agg(F.count("*").alias("large"))


@_register(
    "p31_bind",
    "SELECT 'part/' || p_partkey AS part, p_retailprice * p_size AS worth, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS big FROM part",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "price", "?price"), pt.match(t, "?part", "size", "?size"))
    size = terms.number(F.col("size"))
    bound = pt.bind(found, worth=terms.number(F.col("price")) * size, big=terms.bound_flag(F.when(size > 25, size)))
    return pt.project(bound, "part", "worth", "big", distinct=False)


@_register("p33_distinct", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
def _(t: DataFrame) -> DataFrame:
    return pt.project(pt.conjunction(pt.match(t, "?part", "brand", "?brand"), pt.match(t, "?part", "partType", "?type")), "brand", "type")


@_register(
    "p34_pairs",
    """WITH m AS (SELECT DISTINCT l_orderkey AS k, 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS n
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
       SELECT 'order/' || a.k AS "order", a.n AS nation, a.s AS a, b.s AS b FROM m AS a JOIN m AS b USING (k, n) WHERE a.s < b.s""",
)
def _(t: DataFrame) -> DataFrame:
    of, by = pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "bySupplier", "?supplier")
    tasks = pt.tasks_for(t.sparkSession, of.count())
    line = pt.conjunction(of.repartition(tasks, "line"), by.repartition(tasks, "line"))
    return pt.pairs_in_group(pt.conjunction(line, pt.match(t, "?supplier", "inNation", "?nation")), "order", "supplier", "nation", tasks=tasks)


@_register(
    "p35_exact_members",
    """SELECT 'customer/' || o_custkey AS customer FROM orders GROUP BY o_custkey
       HAVING count(DISTINCT o_orderstatus) = 2 AND bool_and(o_orderstatus IN ('F', 'O'))""",
)
def _(t: DataFrame) -> DataFrame:
    placed = pt.conjunction(pt.match(t, "?order", "placedBy", "?customer"), pt.match(t, "?order", "status", "?status"))
    return pt.exactly_members(placed, "customer", "status", ["F", "O"])


# Aggregates, order and pages.


@_register(
    "a01_a07_aggregates",
    """SELECT 'customer/' || o_custkey AS customer, count(DISTINCT o_orderstatus) AS statuses, count(*) AS orders,
       round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice) + 0.0000123, 3) AS mean, min(o_orderstatus) AS first,
       max(o_orderstatus) AS last, min(o_orderkey::VARCHAR) AS sample FROM orders GROUP BY o_custkey""",
)
def _(t: DataFrame) -> DataFrame:
    placed = pt.conjunction(pt.match(t, "?order", "placedBy", "?customer"), pt.match(t, "?order", "status", "?status"), pt.match(t, "?order", "total", "?total"))
    return agg.group_by(
        placed, ["customer"],
        {
            "statuses": agg.aggregate("COUNT", "status"), "orders": agg.aggregate("COUNT", "order", distinct=False),
            "total": F.round(agg.aggregate("SUM", "total"), 2), "mean": F.round(agg.aggregate("AVG", "total") + 0.0000123, 3),
            "first": agg.aggregate("MIN", "status"), "last": agg.aggregate("MAX", "status"),
            "sample": F.substr(agg.aggregate("SAMPLE", "order"), F.lit(7)),
        },
    )


@_register("a09_having_more", "SELECT 'order/' || l_orderkey AS \"order\", count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def _(t: DataFrame) -> DataFrame:
    return agg.having(agg.group_by(pt.match(t, "?line", "ofOrder", "?order"), ["order"], {"n": agg.aggregate("COUNT", "line", False)}), "n", "more", 6)


@_register("a10_having_range", "SELECT 'order/' || l_orderkey AS \"order\", count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3")
def _(t: DataFrame) -> DataFrame:
    return agg.having(agg.group_by(pt.match(t, "?line", "ofOrder", "?order"), ["order"], {"n": agg.aggregate("COUNT", "line", False)}), "n", "range", 2, 3)


@_register(
    "a11_sampled_others",
    """SELECT p_brand AS brand, count(DISTINCT p_partkey) AS parts, min(p_type) AS type_sample FROM part GROUP BY 1""",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "brand", "?brand"), pt.match(t, "?part", "partType", "?type"))
    return agg.group_by(found, ["brand"], {"parts": agg.aggregate("COUNT", "part")}, sample_others=True).drop("part_sample")


@_register(
    "a12_also_group_by", "SELECT p_brand AS brand, p_type AS type, max(p_retailprice) AS price FROM part GROUP BY 1, 2"
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "brand", "?brand"), pt.match(t, "?part", "partType", "?type"), pt.match(t, "?part", "price", "?price"))
    return agg.group_by(pt.bind(found, price=terms.number(F.col("price"))), ["brand"], {"price": F.max("price")}, also_group_by=["type"])


@_register("a14_global", "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders")
def _(t: DataFrame) -> DataFrame:
    return agg.group_by(pt.match(t, "?order", "placedBy", "?customer"), [], {"customers": agg.aggregate("COUNT", "customer"), "orders": agg.aggregate("COUNT", "order", False)})


@_register(
    "a15_count_equals_key",
    """SELECT 'part/' || p_partkey AS part, p_size AS size FROM part JOIN lineitem ON l_partkey = p_partkey
       GROUP BY p_partkey, p_size HAVING count(*) = p_size""",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?line", "ofPart", "?part"), pt.match(t, "?part", "size", "?size"))
    return agg.count_equals_key(pt.bind(found, size=F.col("size").try_cast("int")), ["part"], "line", "size")


@_register(
    "a16_all_types",
    " UNION ALL ".join(f"SELECT {s} AS s, '{c}' AS types FROM {table}" for c, table, s, _, _ in _CLASSES),
)
def _(t: DataFrame) -> DataFrame:
    # Ids of lines depend on the files' layout, so the result shows none.
    line = F.when(F.col("types") == "Line", "line").otherwise(F.col("s"))
    return agg.joined_types(t).select(line.alias("s"), "types")


@_register(
    "a17_best_label",
    """SELECT source, substr(min(CASE WHEN lang = 'en' THEN '1' WHEN lang = '' THEN '2' ELSE '3' END || text), 2) AS text
       FROM (SELECT source, coalesce(lang, '') AS lang, text FROM documents) WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1""",
)
def _(t: DataFrame) -> DataFrame:
    texts = t.where("p = 'text'").select(F.col("s").alias("d"), F.col("o").alias("text"), "o_lang")
    return agg.best_label(pt.conjunction(texts, pt.match(t, "?d", "source", "?source")), ["source"], "text", "o_lang")


@_register(
    "f14_heaviest_label",
    """SELECT source, (arg_min(text, (-CASE lang WHEN 'en' THEN 1.0 WHEN 'en-gb' THEN 0.8 WHEN 'fr' THEN 0.6 ELSE 0.1 END, text))) AS text
       FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1""",
)
def _(t: DataFrame) -> DataFrame:
    texts = t.where("p = 'text'").select(F.col("s").alias("d"), F.col("o").alias("text"), "o_lang")
    return agg.heaviest_label(pt.conjunction(texts, pt.match(t, "?d", "source", "?source")), ["source"], "text", "o_lang")


@_register(
    "a18_all_predicates",
    "SELECT edge, sum(n)::BIGINT AS count FROM ("
    + " UNION ALL ".join(f"SELECT '{edge}' AS edge, count({column}) AS n FROM {table}" for _, table, _, _, of in _CLASSES for edge, column in of)
    + ") GROUP BY edge HAVING sum(n) > 0",
)
def _(t: DataFrame) -> DataFrame:
    return agg.predicate_counts(t)


@_register(
    "a19_class_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS node_type, count(*) AS count FROM {t}"
        for c, t in (("Order", "orders"), ("Customer", "customer"), ("Supplier", "supplier"), ("Nation", "nation"), ("Region", "region"), ("Part", "part"), ("Line", "lineitem"), ("Document", "documents"))
    ),
)
def _(t: DataFrame) -> DataFrame:
    return agg.class_counts(t)


@_register("o03_top_k", "SELECT 'part/' || p_partkey AS part, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 20")
def _(t: DataFrame) -> DataFrame:
    return agg.top(pt.bind(pt.match(t, "?part", "price", "?price"), price=terms.number(F.col("price"))), 20, "price", ties=["part"])


@_register(
    "o03_top_groups",
    "SELECT 'customer/' || o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer LIMIT 10",
)
def _(t: DataFrame) -> DataFrame:
    counted = agg.group_by(pt.match(t, "?order", "placedBy", "?customer"), ["customer"], {"n": agg.aggregate("COUNT", "order", False)})
    return agg.top(counted, 10, "n", ties=["customer"])


@_register("o04_page", "SELECT DISTINCT p_brand AS brand, (SELECT count(DISTINCT p_brand)::VARCHAR FROM part) AS total FROM part ORDER BY brand LIMIT 10")
def _(t: DataFrame) -> DataFrame:
    rows, total = agg.page(agg.order(pt.project(pt.match(t, "?part", "brand", "?brand"), "brand"), "brand"), "brand")
    return rows.withColumn("total", F.lit(total))


@_register(
    "o05_mask_uris",
    """SELECT CASE WHEN row > 2 THEN '' ELSE uri END AS uri, name, CAST(row AS INTEGER) AS row FROM (
       SELECT 'http://example.org/' || n_nationkey AS uri, n_name AS name, row_number() OVER (ORDER BY n_name) AS row FROM nation)""",
)
def _(t: DataFrame) -> DataFrame:
    nations = pt.exists(pt.match(t, "?n", "rdfs:label", "?name"), pt.instances(t, "?n", "Nation"))
    uri = F.concat(F.lit("http://example.org/"), F.split_part("n", F.lit("/"), F.lit(2)))
    return agg.mask_uris(nations.select(uri.alias("uri"), "name"), ["name"])


@_register(
    "o06_keep_first",
    "SELECT p_brand AS brand, 'part/' || p_partkey AS part, p_retailprice AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey::VARCHAR) = 1",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "brand", "?brand"), pt.match(t, "?part", "price", "?price"))
    return agg.keep_first(pt.bind(found, price=terms.number(F.col("price"))), ["brand"], [F.desc("price"), "part"])


@_register(
    "o07_top5_per_group",
    "SELECT p_brand AS brand, 'part/' || p_partkey AS part, p_retailprice AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey::VARCHAR) <= 5",
)
def _(t: DataFrame) -> DataFrame:
    found = pt.conjunction(pt.match(t, "?part", "brand", "?brand"), pt.match(t, "?part", "price", "?price"))
    return agg.first_per_group(pt.bind(found, price=terms.number(F.col("price"))), ["brand"], [F.desc("price"), "part"], 5)


# Queries built step by step.


@_register("u01_build_query", "SELECT 'customer/' || c_custkey AS customer, c_name AS name FROM customer")
def _(t: DataFrame) -> DataFrame:
    return plans.build_query(t, CUSTOMER)


@_register(
    "u02_filter_by_uri",
    """SELECT 'customer/' || c_custkey AS customer, c_name AS name FROM customer WHERE c_nationkey IN (3, 5)""",
)
def _(t: DataFrame) -> DataFrame:
    return plans.apply_filter(plans.build_query(t, CUSTOMER), t, CUSTOMER, "nation", uris=["nation/3", "nation/5"]).select("customer", "name")


@_register(
    "u03_filter_by_text",
    """SELECT DISTINCT 'customer/' || c_custkey AS customer, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey WHERE n_name ILIKE '%nation_1%' AND o_orderstatus = 'P'""",
)
def _(t: DataFrame) -> DataFrame:
    query = plans.apply_filter(plans.build_query(t, CUSTOMER), t, CUSTOMER, "nation", text="Nation_1")
    return pt.project(plans.apply_filter(query, t, CUSTOMER, "order", text="^p$"), "customer", "name")


@_register(
    "u04_bind_only", "SELECT 'customer/' || c_custkey AS customer, 'segment/' || c_mktsegment AS segment FROM customer"
)
def _(t: DataFrame) -> DataFrame:
    return plans.apply_filter(plans.build_query(t, CUSTOMER), t, CUSTOMER, "segment").select("customer", "segment")


#: Links of the view whose objects have a class: column, and table, key and class of the object.
_LINKS = {
    ("Order", "placedBy"): ("o_custkey", "customer", "c_custkey", "Customer"),
    ("Customer", "inNation"): ("c_nationkey", "nation", "n_nationkey", "Nation"),
    ("Supplier", "inNation"): ("s_nationkey", "nation", "n_nationkey", "Nation"),
    ("Nation", "skos:broader"): ("a.n_regionkey", "region", "r_regionkey", "Region"),
    ("Nation", "linkedTo"): ("(7 * a.n_nationkey + 3) % 25", "nation", "n_nationkey", "Nation"),
    ("Line", "ofOrder"): ("l_orderkey", "orders", "o_orderkey", "Order"),
    ("Line", "ofPart"): ("l_partkey", "part", "p_partkey", "Part"),
    ("Line", "bySupplier"): ("l_suppkey", "supplier", "s_suppkey", "Supplier"),
}
#: Properties whose objects are neither literals nor of a class.
_UNTYPED = ("rdf:type", "priority", "segment", "skos:broader")
#: Schema edges for SQL, each as long as the tables have a row for it.
_SCHEMA_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{cls}' AS source_type, '{p}' AS edge, '{link[3]}' AS target_type WHERE EXISTS (SELECT 1 FROM {table} AS a JOIN {link[1]} AS b ON b.{link[2]} = {link[0]})"
    if (link := _LINKS.get((cls, p)))
    else f"SELECT '{cls}' AS source_type, '{p}' AS edge, 'Literal' AS target_type WHERE EXISTS (SELECT 1 FROM {table} WHERE {column} IS NOT NULL)"
    for cls, table, _, _, properties in _CLASSES
    for p, column in properties
    if (cls, p) in _LINKS or p not in _UNTYPED
) + ") AS e"


@_register(
    "u05_component",
    """SELECT DISTINCT 'customer/' || c_custkey AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)""",
)
def _(t: DataFrame) -> DataFrame:
    query = plans.component_constraint(plans.build_query(t, CUSTOMER), t, sc.schema_edges(t), "customer", "Customer", "Region", ["region/1", "region/2"])
    return pt.project(query, "customer")


@_register(
    "u06_exact_count",
    """SELECT DISTINCT 'order/' || l_orderkey AS "order" FROM lineitem JOIN part ON l_partkey = p_partkey
       WHERE l_quantity = 7 AND p_partkey < 40""",
)
def _(t: DataFrame) -> DataFrame:
    parts = [f"part/{i}" for i in range(40)]
    # From order to line the schema has the inverse arc only, so the edge is given turned round.
    schema = sc.schema_edges(t)
    edges = schema.where("source_type = 'Line'").unionByName(
        sc.inverse_arcs(schema.where("edge = 'ofOrder'"), "Order").select(
            F.lit("Order").alias("source_type"), F.concat(F.lit("^"), F.col("edge")).alias("edge"), F.col("source_type").alias("target_type")
        )
    )
    query = plans.component_constraint(pt.instances(t, "?order", "Order"), t, edges, "order", "Order", "Part", parts, exact_count=7)
    return pt.project(query, "order")


@_register(
    "u07_filter_by_quantity",
    """SELECT 'order/' || o_orderkey AS "order" FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000
       AND CAST(o_orderdate AS DATE) >= '1997-01-01'""",
)
def _(t: DataFrame) -> DataFrame:
    query = plans.filter_by_quantity(pt.instances(t, "?order", "Order"), t, "order", "total", "range", "100000", "120000")
    return plans.filter_by_quantity(query, t, "order", "date", "more", "1997")


@_register(
    "u08_group_by_having",
    "SELECT 'customer/' || o_custkey AS customer, count(*) AS value FROM orders GROUP BY 1 HAVING count(*) > 15",
)
def _(t: DataFrame) -> DataFrame:
    return plans.group_by_having(pt.match(t, "?order", "placedBy", "?customer"), "customer", "order", "COUNT", "more", 15)


@_register(
    "u09_add_triplet",
    """SELECT 'customer/' || c_custkey AS customer, c_name AS name, 'order/' || o_orderkey AS "order" FROM customer
       JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 1""",
)
def _(t: DataFrame) -> DataFrame:
    query = plans.apply_filter(plans.build_query(t, CUSTOMER), t, CUSTOMER, "nation", uris=["nation/1"]).select("customer", "name")
    return plans.add_triplet(query, t, sc.schema_edges(t.where("p IN ('placedBy', 'rdf:type')")), "?customer", "Customer", "^placedBy", "?order", "Order")


@_register("u10_select_aggregate", "SELECT 'nation/' || c_nationkey AS nation, count(DISTINCT c_custkey) AS customer FROM customer GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return plans.select_aggregate(pt.exists(pt.match(t, "?customer", "inNation", "?nation"), pt.instances(t, "?customer", "Customer")), "customer", "COUNT", ["nation"])


@_register("u11_execute", "SELECT 'customer/' || c_custkey AS customer, c_name AS name FROM customer ORDER BY c_name DESC LIMIT 10")
def _(t: DataFrame) -> DataFrame:
    return plans.execute(plans.ensure_not_empty(plans.build_query(t, CUSTOMER)), 10, "name", descending=True, ties=["customer"])


# Entities.


@_register(
    "e01_candidates",
    """WITH l AS (SELECT 'part/' || p_partkey AS entity, p_name AS label,
         list_distinct(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM part)
       SELECT entity, label, 'Part' AS type, 1.0 / len(w) / (abs(length(label) - 4) + 1) AS score FROM l
       WHERE list_contains(w, 'ring') ORDER BY score DESC, entity LIMIT 15""",
)
def _(t: DataFrame) -> DataFrame:
    return en.candidates(t, "Ring")


@_register(
    "e03_fallback",
    """SELECT 'customer/' || c_custkey AS entity, c_name AS label, 'Customer' AS type,
       1.0 / (abs(length(c_name) - 18) + 1) AS score FROM customer WHERE c_name = 'Customer#000000042'""",
)
def _(t: DataFrame) -> DataFrame:
    return en.candidates_or_any(t, "customer 000000042", "artist")


@_register(
    "e04_all_labels",
    " UNION ALL ".join(f"SELECT {s} AS s, {label} AS label FROM {table} WHERE {label} IS NOT NULL" for _, table, s, label, _ in _CLASSES if label),
)
def _(t: DataFrame) -> DataFrame:
    return en.labels_of(t)


@_register(
    "e05_resolve",
    """SELECT n_name AS name, 'nation/' || n_nationkey AS entity, n_name AS label, 1.0 AS score FROM nation
       UNION ALL SELECT 'nothing at all', NULL, NULL, NULL""",
)
def _(t: DataFrame) -> DataFrame:
    nations = pt.exists(pt.match(t, "?n", "rdfs:label", "?name"), pt.instances(t, "?n", "Nation")).select("name")
    return en.resolve(t, nations.union(t.sparkSession.createDataFrame([("nothing at all",)], ["name"])))


@_register(
    "e06_profile",
    """SELECT 'nation/' || n_nationkey AS s, n_name AS label, 'Nation' AS type, 'linkedTo' AS p,
       'nation/' || ((7 * n_nationkey + 3) % 25) AS o, (SELECT m.n_name FROM nation AS m WHERE m.n_nationkey = (7 * n.n_nationkey + 3) % 25) AS o_label FROM nation AS n
       UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'Nation', 'skos:broader', 'region/' || n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def _(t: DataFrame) -> DataFrame:
    return en.profile(t, pt.instances(t, "?s", "Nation")).select("s", "label", "type", "p", F.inline("objects"))


@_register(
    "e07_equivalents",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS s, (7 * n_nationkey + 3) % 25 AS o FROM nation),
       b AS (SELECT s, o FROM e WHERE s <> o UNION SELECT o, s FROM e WHERE s <> o),
       r AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT r.start, b.o FROM r JOIN b ON b.s = r.node),
       q AS (SELECT 'nation/' || start AS start, 'nation/' || node AS node FROM r)
       SELECT start, node FROM q QUALIFY row_number() OVER (PARTITION BY start ORDER BY start <> node, node) <= 10""",
)
def _(t: DataFrame) -> DataFrame:
    return en.equivalents(t, pt.instances(t, "?start", "Nation"), ["linkedTo"])


@_register(
    "e08_preferred",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS s, (7 * n_nationkey + 3) % 25 AS o FROM nation),
       b AS (SELECT s, o FROM e WHERE s <> o UNION SELECT o, s FROM e WHERE s <> o),
       r AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT r.start, b.o FROM r JOIN b ON b.s = r.node),
       q AS (SELECT 'nation/' || start AS start, 'nation/' || node AS node FROM r),
       k AS (SELECT start, node FROM q QUALIFY row_number() OVER (PARTITION BY start ORDER BY start <> node, node) <= 10),
       i AS (SELECT *, bool_or(node LIKE 'nation/1%') OVER (PARTITION BY start) AS any_inside FROM k)
       SELECT start, node FROM i WHERE CASE WHEN any_inside THEN node LIKE 'nation/1%' ELSE node = start END
       QUALIFY row_number() OVER (PARTITION BY start ORDER BY start <> node, node) <= 4""",
)
def _(t: DataFrame) -> DataFrame:
    return en.preferred_equivalents(en.equivalents(t, pt.instances(t, "?start", "Nation"), ["linkedTo"]), "nation/1")


@_register("e10_unknown_uris", "SELECT * FROM (VALUES ('nation/77'), ('nation/x')) AS v(uri)")
def _(t: DataFrame) -> DataFrame:
    return en.unknown_uris(t, ["nation/1", "nation/77", "nation/x", "elsewhere/1"], "nation/")


# Schema.


@_register("g01_schema_edges", f"SELECT * FROM {_SCHEMA_SQL}")
def _(t: DataFrame) -> DataFrame:
    return sc.schema_edges(t)


@_register(
    "g02_pruned_edges",
    f"""WITH n AS (SELECT 'Order' AS c, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'Customer', (SELECT count(*) FROM customer)
        UNION ALL SELECT 'Part', (SELECT count(*) FROM part) UNION ALL SELECT 'Supplier', (SELECT count(*) FROM supplier)
        UNION ALL SELECT 'Line', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'Document', (SELECT count(*) FROM documents)
        UNION ALL SELECT 'Nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'Region', (SELECT count(*) FROM region)),
        f AS (SELECT c FROM n WHERE n >= 1000)
        SELECT e.* FROM {_SCHEMA_SQL} WHERE source_type IN (SELECT c FROM f) AND target_type IN (SELECT c FROM f)""",
)
def _(t: DataFrame) -> DataFrame:
    return sc.schema_edges(t, literal_mode=0, min_nodes=1000)


@_register(
    "g03_numbered_literals",
    f"""SELECT source_type, edge, 'Literal_' || row_number() OVER (ORDER BY source_type, edge) AS target_type
        FROM {_SCHEMA_SQL} WHERE target_type = 'Literal'""",
)
def _(t: DataFrame) -> DataFrame:
    return sc.schema_edges(t, literal_mode=2).where(F.col("target_type").startswith(sc.LITERAL))


@_register("g04_inverse_arcs", f"SELECT source_type, edge FROM {_SCHEMA_SQL} WHERE target_type = 'Nation'")
def _(t: DataFrame) -> DataFrame:
    return sc.inverse_arcs(sc.schema_edges(t), "Nation")


@_register(
    "g05_incoming",
    """SELECT 'inNation' AS p, min(s) AS example FROM (SELECT 'customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 3
       UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3)
       UNION ALL SELECT 'linkedTo', min('nation/' || n_nationkey) FROM nation WHERE (7 * n_nationkey + 3) % 25 = 3""",
)
def _(t: DataFrame) -> DataFrame:
    return sc.incoming_predicates(t, "nation/3")


_PATHS_SQL = f"""WITH RECURSIVE r AS (
  SELECT source_type || ' ' || edge || ' ' || target_type AS path, [source_type, target_type] AS nodes, target_type AS last, edge, 1 AS size
  FROM {_SCHEMA_SQL} WHERE source_type = 'Line' AND source_type <> target_type
  UNION ALL
  SELECT r.path || ' / ' || e.source_type || ' ' || e.edge || ' ' || e.target_type, list_append(nodes, e.target_type), e.target_type, e.edge, size + 1
  FROM r JOIN {_SCHEMA_SQL} ON e.source_type = r.last WHERE NOT list_contains(nodes, e.target_type) AND size < 5 AND r.last <> 'Region')
"""


@_register("g06_simple_paths", f"{_PATHS_SQL} SELECT path, size FROM r WHERE last = 'Region'")
def _(t: DataFrame) -> DataFrame:
    return sc.simple_paths(sc.schema_edges(t), "Line", "Region").select(sc._path_key().alias("path"), "size")


@_register(
    "g07_g08_reduced_paths",
    f"{_PATHS_SQL} SELECT path, size FROM r WHERE last = 'Region' QUALIFY row_number() OVER (PARTITION BY edge ORDER BY size, path) <= 5",
)
def _(t: DataFrame) -> DataFrame:
    edges = sc.schema_edges(t)
    return sc.paths_with_data(sc.reduce_paths(sc.simple_paths(edges, "Line", "Region")), edges).select(sc._path_key().alias("path"), "size")


@_register("g09_k_shortest", f"{_PATHS_SQL} SELECT path, size FROM r WHERE last = 'Region' ORDER BY size, path LIMIT 1")
def _(t: DataFrame) -> DataFrame:
    return sc.k_shortest_paths(sc.schema_edges(t), "Line", "Region", 1).select(sc._path_key().alias("path"), "size")


@_register("g10_neighbourhood", f"SELECT * FROM {_SCHEMA_SQL} WHERE 'Order' IN (source_type, target_type)")
def _(t: DataFrame) -> DataFrame:
    return sc.neighbourhood(sc.schema_edges(t), "Order")


@_register(
    "g10_neighbourhood_2",
    f"SELECT * FROM {_SCHEMA_SQL} WHERE source_type IN ('Order', 'Line', 'Customer') OR target_type IN ('Order', 'Line', 'Customer')",
)
def _(t: DataFrame) -> DataFrame:
    return sc.neighbourhood(sc.schema_edges(t), "Order", 2)


@_register(
    "g11_summary",
    """SELECT * FROM (VALUES ('Line', 'bySupplier', 'Supplier'), ('Line', 'ofOrder', 'Order'), ('Line', 'ofPart', 'Part'),
       ('Order', 'placedBy', 'Customer'), ('Customer', 'inNation', 'Nation'), ('Supplier', 'inNation', 'Nation'),
       ('Nation', 'skos:broader', 'Region'), ('', '', 'Document')) AS v(source_type, edge, target_type)""",
)
def _(t: DataFrame) -> DataFrame:
    shown, alone = sc.summary(sc.schema_edges(t), agg.predicate_counts(t), agg.class_counts(t))
    return shown.unionByName(alone.select(F.lit("").alias("source_type"), F.lit("").alias("edge"), F.col("node_type").alias("target_type")))


@_register("g13_quantity_property", "SELECT 'Line' AS source_type, 'quantity' AS edge")
def _(t: DataFrame) -> DataFrame:
    return sc.quantity_property(sc.schema_edges(t))


@_register("g14_search_terms", f"SELECT DISTINCT edge AS term FROM {_SCHEMA_SQL} WHERE lower(edge) LIKE '%or%'")
def _(t: DataFrame) -> DataFrame:
    return sc.search_terms(sc.schema_edges(t), "OR", "predicate")


@_register(
    "g15_variable_classes",
    f"SELECT edge, min(source_type) AS domain, min(CASE WHEN target_type <> 'Literal' THEN target_type END) AS range FROM {_SCHEMA_SQL} GROUP BY 1",
)
def _(t: DataFrame) -> DataFrame:
    return sc.variable_classes(t, sc.schema_edges(t))


# Runs and answers: events as steps of traces (one user a trace), orders as answers.


@_register_tables(
    "v01_answer_accuracy",
    """WITH e AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'),
       p AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS v FROM orders WHERE o_orderpriority LIKE '1%')
       SELECT q AS question_id, round(count(e.v) / count(p.v), 3) AS accuracy FROM p LEFT JOIN e USING (q, v) GROUP BY q
       UNION ALL SELECT q, 0.0 FROM (SELECT DISTINCT q FROM e) WHERE q NOT IN (SELECT q FROM p)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    cells = orders.select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("row_id"), F.lit("order").alias("col"),
        F.concat(F.lit("http://example.org/order/"), F.col("o_orderkey")).alias("value"), "o_orderstatus", "o_orderpriority",
    )
    return ev.answer_accuracy(cells.where("o_orderstatus = 'F'"), cells.where("o_orderpriority LIKE '1%'"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    events = numbered(events, ["user_id", "ts", "event_id"], "seq")
    return events.select(F.col("user_id").alias("trace_id"), "seq", F.col("event_type").alias("name"), status.alias("status"), F.col("props").alias("content"))


@_register_tables("v04_schema_errors", "SELECT user_id AS trace_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.schema_errors(_calls(spark, sf_dir))


# A call of a trace is a step of the recursion; the steps still open are a list of their places.
@_register_tables(
    "v05_workflow_drift",
    """WITH RECURSIVE c AS (SELECT user_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type <> 'error' AS ok,
         list_position(['signup', 'click', 'purchase'], event_type) AS place FROM events),
       r AS (SELECT DISTINCT user_id AS t, 0::BIGINT AS seq, false AS started, [1, 2, 3] AS open, 0 AS errors FROM events
         UNION ALL
         SELECT r.t, c.seq, started OR (c.ok AND coalesce(place = 1, false)),
           CASE WHEN c.ok AND coalesce(place = 1, false) THEN [2, 3] WHEN started AND c.ok THEN list_filter(open, lambda x: x IS DISTINCT FROM place) ELSE open END,
           errors + CASE WHEN c.ok AND coalesce(place = 1, false) THEN 0
             WHEN NOT started OR NOT coalesce(list_contains(open, place), false) OR (NOT c.ok AND open[1] IS DISTINCT FROM place) THEN 1 ELSE 0 END
         FROM r JOIN c ON c.t = r.t AND c.seq = r.seq + 1),
       e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY t ORDER BY seq DESC) = 1)
       SELECT t AS trace_id, CASE WHEN started THEN errors + len(open) ELSE 3 END AS errors FROM e""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    steps = F.array(F.lit("signup()"), F.lit("click(id=1)"), F.lit("purchase(id=1)"))
    return ev.workflow_drift(calls, calls.select("trace_id").distinct().withColumn("steps", steps))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    parent = F.when(F.col("event_type") != "signup", F.lit("p"))
    return events.select(
        F.col("user_id").alias("trace_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), parent.alias("parent_run_id"),
        F.when(F.col("event_type").isin("click", "error"), "tool").otherwise("chain").alias("run_type"), F.col("event_type").alias("name"),
        F.col("props").alias("inputs"), F.lit("").alias("outputs"), F.col("ts").alias("start_time"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )


@_register_tables(
    "v06_trace_roots",
    """SELECT user_id AS trace_id, lpad(event_id::VARCHAR, 12, '0') AS run_id FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'signup', ts, event_id) = 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.trace_roots(_steps(spark, sf_dir)).select("trace_id", "run_id")


@_register_tables(
    "v07_tool_steps",
    """SELECT user_id AS trace_id, count(*) AS n, string_agg(event_type || '=' || json_extract_string(props, '$.k') || CASE WHEN event_type = 'error' THEN '!' ELSE '' END,
       ' ' ORDER BY ts, event_id) AS calls FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("tools", lambda c: F.concat(c["name"], F.lit("="), c["input"], F.when(c["success"], "").otherwise("!")))
    return ev.tool_steps(_steps(spark, sf_dir)).select("trace_id", F.size("tools").cast("long").alias("n"), F.array_join(told, " ").alias("calls"))


@_register_tables(
    "v08_feedback_pivot",
    """SELECT user_id AS run_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click,
       arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), F.lit(None).cast("double").alias("score"), "value", F.col("event_id").alias("seq")
    )
    return ev.feedback_pivot(feedback, ["click", "purchase"])


@_register_tables(
    "v09_final_query",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text END AS g, CASE WHEN role = 'assistant' THEN turn END AS id,
         CASE WHEN role = 'user' AND turn > 0 THEN turn - 1 END AS x FROM conversations),
       x AS (SELECT conv_id, max(x) AS id FROM m GROUP BY 1)
       SELECT conv_id AS trace_id, coalesce(max(m.g) FILTER (m.id = x.id), arg_max(m.g, turn) FILTER (m.g IS NOT NULL), '') AS query
       FROM m JOIN x USING (conv_id) GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations")
    answer = F.col("role") == "assistant"
    return ev.final_query(
        talk.select(
            F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.when(answer, F.col("text")).alias("generated_query"),
            F.when(answer, F.col("turn")).alias("query_id"), F.when((F.col("role") == "user") & (F.col("turn") > 0), F.col("turn") - 1).alias("executed_query_id"),
        )
    )


@_register_tables("v10_question_text", "SELECT event_id, json_extract_string(props, '$.k') AS question FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.regexp_replace("props", '"k"', '"query_input"')
    return _table(spark, sf_dir, "events").select("event_id", ev.question_text(asked).alias("question"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs: configuration by return flag, question by supplier, discount as accuracy."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("config"), F.col("l_suppkey").alias("question"), (F.col("l_discount") * 10).alias("accuracy"),
        F.when(F.col("l_linestatus") == "F", "impossible").otherwise("easy").alias("difficulty"), F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_tax").alias("latency"), F.col("l_linenumber").alias("n_tools"), *((F.col("l_linenumber") % i == 0).cast("int").alias(f"type_{i}") for i in (1, 2, 3)),
    )


@_register_tables(
    "v11_accuracy_by_difficulty",
    """SELECT l_returnflag AS config, CASE WHEN l_linestatus = 'F' THEN 'very hard' ELSE 'easy' END AS difficulty, round(avg(l_discount * 10), 6) AS accuracy
       FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_returnflag, 'all', round(avg(l_discount * 10), 6) FROM lineitem GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy_by_difficulty(_runs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@_register_tables(
    "v12_v17_compare",
    """WITH r AS (SELECT l_returnflag AS config, l_suppkey AS q, l_discount * 10 AS a, l_quantity AS t, l_tax AS l, l_linenumber AS n FROM lineitem),
       s AS (SELECT config, q, stddev_pop(a) AS sd, count(*) AS n FROM r GROUP BY 1, 2),
       c AS (SELECT config, greatest(0, least(1, 1 - 2 * avg(sd))) AS consistency, arg_min(n, q) AS passes FROM s GROUP BY 1)
       SELECT config, round(avg(a), 6) AS accuracy, round(any_value(consistency), 6) AS consistency, round(sum(t) / any_value(passes), 6) AS tokens_per_pass,
       round(avg(l), 6) AS latency, round(avg(n), 6) AS tool_calls, 1.0 AS type_1, round(avg((n % 2 = 0)::INT), 6) AS type_2,
       round(avg((n % 3 = 0)::INT), 6) AS type_3 FROM r JOIN c USING (config) GROUP BY config""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.compare_configurations(_runs(spark, sf_dir))
    return out.select("config", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def _outside_parentheses(text: str, depth: int = 12) -> str:
    """SQL that takes pairs of parentheses out, the inner ones first, as deep as documents go."""
    for _ in range(depth):
        text = f"regexp_replace({text}, '\\([^()]*\\)', ' ', 'g')"
    return text


_HOPS_SQL = f"""WITH h AS (SELECT lang, q, len(regexp_extract_all({_outside_parentheses("text")}, '[./;,]')) AS n FROM (SELECT lang, coalesce(text, '') AS q,
       regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), '{{', ' '), '}}', ' '), '(?m)^#.*\\n?', '', 'g'),
       '"[^"\\\\]*(?:\\\\[^\\n][^"\\\\]*)*"', ' ', 'g'), '<[^>]*>', ' ', 'g') AS text FROM documents))
       SELECT lang, CASE WHEN regexp_matches(upper(q), '\\b(GROUP BY|COUNT|ORDER BY)\\b') THEN 'hard' WHEN n <= 5 THEN 'easy' WHEN n <= 13 THEN 'medium' ELSE 'hard' END AS split,
       count(*) AS count FROM h GROUP BY 1, 2"""


@_register_tables("v18_v20_query_difficulty", _HOPS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.translate(F.coalesce("text", F.lit("")), "{}", "  ")
    docs = _table(spark, sf_dir, "documents")
    return ev.split_counts(docs.select(F.struct("lang", ev.query_difficulty(bare, F.lit("")).alias("split")).alias("k")), "k").select("k.*", "count")


@_register_tables(
    "v21_select_examples",
    "SELECT 'doc' || doc_id AS file_path FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'de') ORDER BY 1 OFFSET 5",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("file_path"), F.col("source").alias("origin"), F.col("lang").alias("split")
    )
    return ev.select_examples(docs, ["src1", "src2"], ["en", "de"], 5).select("file_path")


@_register_tables("s09_flat_bindings", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = F.regexp_replace("props", r'"k": (\w+)', r'"k": {"type": "literal", "value": "$1"}')
    rows = readers.flat_bindings(_table(spark, sf_dir, "events").select("event_id", bound.alias("row")), "row")
    return rows.select("event_id", rows["row"]["k"].alias("k"))


@_register_tables(
    "f01_f04_names",
    """SELECT DISTINCT 'http://www.w3.org/2000/01/rdf-schema#' || p_type AS full_name, 'rdfs:' || p_type AS short_name,
       'rdfs:' || p_type AS known, 'rdf:' || p_type AS label FROM part""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = terms.expand(F.concat(F.lit("<rdfs:"), F.col("p_type"), F.lit(">")))
    named = _table(spark, sf_dir, "part").select(full.alias("full_name")).distinct()
    name = F.col("full_name")
    return named.select("full_name", terms.contract(name).alias("short_name"), terms.contract_known(name).alias("known"), terms.short_label(name).alias("label"))


@_register_tables(
    "f06_f17_values",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, make_date(year(o_orderdate)::INT, 1, 1) AS first, make_date(year(o_orderdate)::INT, 12, 31) AS last,
       year(o_orderdate)::INT AS year, o_totalprice AS number, true AS plain, (o_orderkey % 1000) * 60.0 AS seconds FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    text, year = F.date_format(date, "dd-MM-yyyy"), F.date_format(date, "yyyy")
    price = F.col("o_totalprice").cast("string")
    took = F.concat(F.lit("PT"), (F.col("o_orderkey") % 1000).cast("string"), F.lit("M"))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", terms.first_day(text).alias("day"), terms.first_day(year).alias("first"), terms.last_day(year).alias("last"), terms.year(date).alias("year"),
        terms.number(price).alias("number"), (terms.is_plain_number(price)).alias("plain"), terms.duration_seconds(took).alias("seconds"),
    )


# Sources and sinks: the driver's rows written by a sink, read back by the source, and asked.


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_register_tables(
    "s01_triples_by_predicate",
    """SELECT 'total' AS p, count(o_totalprice) AS n, round(sum(o_totalprice::DOUBLE), 2) AS number, NULL::DATE AS first_day, NULL::DATE AS last_day FROM orders
       UNION ALL SELECT 'date', count(o_orderdate), NULL, min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM orders
       UNION ALL SELECT 'placedBy', count(o_custkey), NULL, NULL, NULL FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "triples")
    readers.write_triples(pt.of_predicates(triples(spark, sf_dir), "total", "date", "placedBy"), path)
    back = readers.read_triples(spark, path, typed=True)
    dated = F.col("p") == "date"
    return back.groupBy("p").agg(
        F.count("o").alias("n"), F.round(F.sum(F.when(F.col("p") == "total", F.col("o_num"))), 2).alias("number"),
        F.min(F.when(dated, F.col("o_first_day"))).alias("first_day"), F.max(F.when(dated, F.col("o_last_day"))).alias("last_day"),
    )


@_register_tables("s02_edge_list", "SELECT 'order/' || o_orderkey AS subj, 'placedBy' AS pred, 'customer/' || o_custkey AS obj FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "edges")
    pt.of_predicates(triples(spark, sf_dir), "placedBy").select("s", "p", "o").write.csv(path)
    return readers.read_edge_list(spark, path)


@_register_tables(
    "s03_s04_statistics",
    """SELECT 'placedBy' AS name, count(o_custkey) AS count FROM orders UNION ALL SELECT 'status', count(o_orderstatus) FROM orders
       UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Order placedBy Customer', 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    some, typed = pt.of_predicates(t, "placedBy", "status"), pt.of_predicates(t, pt.TYPE).where("o IN ('Order', 'Customer')")
    paths = [_scratch(spark, n) for n in ("schema", "predicates", "classes")]
    for df, path in zip((sc.schema_edges(some.unionAll(typed), literal_mode=0), agg.predicate_counts(some), agg.class_counts(typed.where("o = 'Order'"))), paths, strict=True):
        readers.write_csv(df, path)
    edges, predicates, classes = readers.read_statistics(spark, *paths)
    told = edges.select(F.concat_ws(" ", "source_type", "edge", "target_type").alias("name"), F.lit(1).cast("long").alias("count"))
    return predicates.toDF("name", "count").unionByName(classes.toDF("name", "count")).unionByName(told)


@_register_tables(
    "s05_query_corpus",
    """SELECT 'names' AS category, 'easy' AS split, 'nation ' || s_nationkey AS origin, 'Who is ' || s_name || ' ?' AS question,
       'SELECT * WHERE { ?s rdfs:label "' || s_name || '" }' AS query, 'find(' || s_suppkey || ') / run()' AS workflow FROM supplier""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "corpus")
    lines = F.concat(
        F.lit('# category: "names"\n# split: easy\n# origin: nation '), F.col("s_nationkey"), F.lit("\n# question: Who is "), F.col("s_name"),
        F.lit(' ?\n# query:\nSELECT * WHERE { ?s rdfs:label "'), F.col("s_name"), F.lit('" }\n# workflow\nfind('), F.col("s_suppkey"), F.lit(")\n\nrun()"),
    )
    # Many records a file: a file for each supplier would cost more than all else. A test has the surveyed corpus's form, a record a file.
    _table(spark, sf_dir, "supplier").select(lines.alias("value")).write.text(path, lineSep="\x1e")
    found = readers.read_query_corpus(spark, path, "\x1e")
    return found.select("category", "split", "origin", "question", "query", F.array_join("workflow", " / ").alias("workflow"))


@_register_tables(
    "s06_s08_runs",
    """SELECT o_orderkey::VARCHAR AS run_id, 'question: Order ' || o_orderkey || chr(10) || '- find(' || o_custkey || ')' || CASE WHEN o_orderstatus = 'F' THEN ' ERROR' ELSE '' END
       || chr(10) || 'query:' || chr(10) || 'SELECT ' || o_orderkey || chr(10) || 'accuracy: ' || CASE o_orderstatus WHEN 'O' THEN '1.0' ELSE '0.0' END || '   llm: 0.0'
       || chr(10) || repeat('-', 40) AS report FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    tool = F.struct(F.lit("find").alias("name"), F.col("o_custkey").cast("string").alias("input"), (F.col("o_orderstatus") != "F").alias("success"))
    runs = _table(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.concat(F.lit("Order "), key).alias("question"), F.struct(F.concat(F.lit("SELECT "), key).alias("generated_query")).alias("output"),
        F.struct(F.when(F.col("o_orderstatus") == "O", 1.0).alias("accuracy")).alias("metrics"), F.array(tool).alias("tools"),
    )
    path = _scratch(spark, "runs")
    readers.write_runs(runs, path)
    return readers.run_report(readers.read_runs(spark, path, multi_line=False), "run_id").withColumnRenamed("value", "report")


# Branches that no query above reaches.


@_register(
    "e09_expand_restriction",
    """WITH l AS (SELECT o_orderkey, 'customer/' || o_custkey AS c, 'order/' || o_orderkey AS o FROM orders),
       k AS (SELECT c, o FROM l QUALIFY row_number() OVER (PARTITION BY c ORDER BY o) <= 4)
       SELECT k.o AS "order", 'priority/' || o_orderpriority AS priority FROM k JOIN orders ON o = 'order/' || o_orderkey
       WHERE c IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_nationkey = 3)""",
)
def _(t: DataFrame) -> DataFrame:
    """Customers of a nation, for whom the orders linked to them stand in: at most four of each."""
    placed = pt.of_predicates(t, "placedBy").select("s", F.lit("owl:sameAs").alias("p"), "o", "o_kind", "o_dt", "o_lang")
    wanted = pt.match(t, "?customer", "inNation", "nation/3")
    customers = pt.exists(wanted, pt.instances(t, "?customer", "Customer"))
    nodes = en.expand_restriction(placed, customers, "order/", most=None)
    return pt.exists(pt.match(t, "?order", "priority", "?priority"), nodes.withColumnRenamed("node", "order"))


@_register(
    "f08_default",
    """SELECT 'part/' || p_partkey AS part, coalesce(max(l_quantity)::DOUBLE, 1.0) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey""",
)
def _(t: DataFrame) -> DataFrame:
    """Parts with their largest quantity over 49; 1 stands for none."""
    line = pt.conjunction(pt.match(t, "?line", "quantity", "?q").where(pt.number_filter("q", "more", 50)), pt.match(t, "?line", "ofPart", "?part"))
    most = line.groupBy("part").agg(F.max(terms.number(F.col("q"))).alias("most"))
    return pt.bind(pt.optional(pt.instances(t, "?part", "Part"), most), quantity=terms.or_default(F.col("most"), 1.0)).select("part", "quantity")


@_register_tables("v14_latency", "SELECT user_id AS trace_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trace_id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return spans.select("trace_id", ev.latency_seconds().alias("seconds"))


def _order_spans(t: DataFrame) -> DataFrame:
    """Orders with a span from their date to the last shipping date of their lines, and a duration in minutes."""
    lines = pt.conjunction(pt.match(t, "?line", "ofOrder", "?order"), pt.match(t, "?line", "shipDate", "?ship")).groupBy("order").agg(F.max("ship").alias("o"))
    begun = pt.match(t, "?order", "date", "?o")
    span = F.concat(F.col("order"), F.lit("/span"))

    def of(rows: DataFrame, s, p: str, o) -> DataFrame:
        return rows.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    key, minutes = F.regexp_extract("order", r"(\d+)$", 1).cast("long"), F.col("order")
    took = F.concat(F.lit("PT"), (key % 90).cast("string"), F.lit("M"))
    return reduce(DataFrame.unionAll, (
        of(begun, F.col("order"), "hasTimeSpan", span), of(begun, span, "begins", F.col("o")), of(lines, span, "ends", F.col("o")), of(begun, minutes, "took", took),
    ))


_ORDER_SPAN_SQL = """(SELECT 'order/' || o_orderkey AS "order", o_orderkey, CAST(o_orderdate AS DATE) AS b, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey) AS e FROM orders)"""


@_register(
    "u07_spans_and_durations",
    f"""SELECT 'range' AS kind, "order" FROM {_ORDER_SPAN_SQL} WHERE b >= '1997-01-01' AND e <= '1997-12-31'
        UNION ALL SELECT 'equal', "order" FROM {_ORDER_SPAN_SQL} WHERE b <= '1997-06-01' AND e >= '1997-06-01'
        UNION ALL SELECT 'less', "order" FROM {_ORDER_SPAN_SQL} WHERE b < '1995-01-01'
        UNION ALL SELECT 'duration', "order" FROM {_ORDER_SPAN_SQL} WHERE o_orderkey % 90 >= 60""",
)
def _(t: DataFrame) -> DataFrame:
    # Written once: every question below joins them, some twice.
    spans, orders = written(_order_spans(t)), written(pt.instances(t, "?order", "Order"))

    def asked(kind: str, operator: str, start: str, end: str | None = None) -> DataFrame:
        return plans.filter_by_quantity(orders, spans, "order", "hasTimeSpan", operator, start, end, ["begins"], ["ends"], kind)

    found = {"range": asked("span", "range", "1997", "1997"), "equal": asked("span", "equal", "1997-06-01"), "less": asked("span", "less", "1995")}
    found["duration"] = plans.filter_by_quantity(orders, spans, "order", "took", "more", "PT1H")
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "order") for kind, df in found.items()))


@_register_tables(
    "v03_value_fallback",
    """WITH e AS (SELECT DISTINCT l_orderkey AS q, l_linestatus AS v FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS q, l_returnflag AS v FROM lineitem)
       SELECT q AS question_id, round(count(e.v) / count(p.v), 3) AS accuracy FROM p LEFT JOIN e USING (q, v) GROUP BY q""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without URIs: all values count."""
    lines = _table(spark, sf_dir, "lineitem")

    def cells(column: str) -> DataFrame:
        return lines.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("row_id"), F.lit("flag").alias("col"), F.col(column).alias("value"))

    return ev.answer_accuracy(cells("l_linestatus"), cells("l_returnflag"))


@_register("g09_three_shortest", f"{_PATHS_SQL} SELECT path, size FROM r WHERE last = 'Region' ORDER BY size, path LIMIT 3")
def _(t: DataFrame) -> DataFrame:
    return sc.k_shortest_paths(sc.schema_edges(t), "Line", "Region", 3).select(sc._path_key().alias("path"), "size")


@_register(
    "p32_select_all",
    """SELECT DISTINCT 'supplier/' || s_suppkey AS supplier, s_name AS name, 'nation/' || s_nationkey AS nation FROM supplier""",
)
def _(t: DataFrame) -> DataFrame:
    named = pt.exists(pt.match(t, "?supplier", "rdfs:label", "?name"), pt.instances(t, "?supplier", "Supplier"))
    return pt.project(pt.conjunction(named, pt.match(t, "?supplier", "inNation", "?nation")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation that placed orders, each with one label and the number of its orders, most first."""
    t = triples(spark, sf_dir)
    query = plans.apply_filter(plans.build_query(t, CUSTOMER), t, CUSTOMER, "nation", text="NATION_1")
    query = pt.conjunction(query, pt.match(t, "?order", "placedBy", "?customer"))
    out = agg.group_by(query, ["customer"], {"name": agg.aggregate("SAMPLE", "name"), "orders": agg.aggregate("COUNT", "order")})
    return plans.execute(out, 100, "orders", descending=True, ties=["customer"])


CATALOG["flagship"] = (
    flagship,
    """SELECT 'customer/' || c_custkey AS customer, c_name AS name, count(*) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey WHERE n_name ILIKE '%nation_1%' GROUP BY 1, 2 ORDER BY orders DESC, customer LIMIT 100""",
)

# Names that these questions had when they read a part of the view.
for old, whole in (
    ("p06_variable_predicate", "p06_all_properties"), ("a16_joined_types", "a16_all_types"), ("a18_predicate_counts", "a18_all_predicates"),
    ("e04_labels", "e04_all_labels"), ("v18_v20_all_documents", "v18_v20_query_difficulty"),
):
    CATALOG[old] = CATALOG[whole]

QUERIES: dict[str, Query] = {name: query for name, (query, _) in CATALOG.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in CATALOG.items() if sql}
