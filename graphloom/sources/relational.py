"""A view of relational tables as triples."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRING, INTEGER, DOUBLE, DATE = "string", "integer", "double", "date"


def _uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key.cast("string"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, suppliers, nations, regions, parts, lines and documents as triples.

    Nothing is read but what a pattern asks for: the view's attribute by_predicate has each predicate's triples, which
    patterns take from there, so that plans stay small; a filter on p has the same effect. Each branch reads its own
    two columns. Null objects give no triple. Lines get a surrogate id, which depends
    on the files' layout.

    The view's attribute by_subject has the triples but those of types by rows of the tables, for what looks at all of
    a subject's triples: (rows, literals, links), rows being (k, s, literals_, links_): the table's number, a subject,
    bit i of literals_ set if it has the table k's literal i, and the object of each link, or null.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def branch(rows: DataFrame, s: Column, p: str, o: Column, kind: str, lang: Column | None = None) -> DataFrame:
        return rows.where(o.isNotNull()).select(
            s.alias("s"),
            F.lit(p).alias("p"),
            o.cast("string").alias("o"),
            F.lit("uri" if kind == "uri" else "literal").alias("o_kind"),
            F.lit(None if kind == "uri" else kind).cast("string").alias("o_dt"),
            (lang if lang is not None else F.lit(None if kind == "uri" else "").cast("string")).alias("o_lang"),
        )

    parts: dict[str, list[DataFrame]] = defaultdict(list)
    wide: list[DataFrame] = []
    literals: list[list[str]] = []
    links: list[list[str]] = []

    def entity(name: str, cls: str, key: str, *properties: tuple, rows: DataFrame | None = None) -> None:
        rows = table(name) if rows is None else rows
        s = _uri(cls.lower(), F.col(key))
        parts["rdf:type"].append(branch(rows, s, "rdf:type", F.lit(cls), "uri"))
        for p in properties:
            parts[p[0]].append(branch(rows, s, *p))
        own = [[p for p in properties if (p[2] == "uri") == uri] for uri in (False, True)]
        bits = reduce(lambda a, b: a + b, (F.when(p[1].isNotNull(), F.lit(1 << i)).otherwise(0) for i, p in enumerate(own[0])), F.lit(0)).cast("long")
        objects = F.array(*(p[1].cast("string") for p in own[1])).cast("array<string>")
        wide.append(rows.select(F.lit(len(wide)).alias("k"), s.alias("s"), bits.alias("literals_"), objects.alias("links_")))
        for names, some in zip((literals, links), own, strict=True):
            names.append([p[0] for p in some])

    c = F.col
    entity(
        "orders", "Order", "o_orderkey",
        ("placedBy", _uri("customer", c("o_custkey")), "uri"),
        ("date", c("o_orderdate").cast("date"), DATE),
        ("total", c("o_totalprice").cast("double"), DOUBLE),
        ("status", c("o_orderstatus"), STRING),
        ("priority", _uri("priority", c("o_orderpriority")), "uri"),
    )
    entity(
        "customer", "Customer", "c_custkey",
        ("rdfs:label", c("c_name"), STRING),
        ("inNation", _uri("nation", c("c_nationkey")), "uri"),
        ("segment", _uri("segment", c("c_mktsegment")), "uri"),
        ("balance", c("c_acctbal").cast("double"), DOUBLE),
    )
    entity(
        "supplier", "Supplier", "s_suppkey",
        ("rdfs:label", c("s_name"), STRING),
        ("inNation", _uri("nation", c("s_nationkey")), "uri"),
        ("balance", c("s_acctbal").cast("double"), DOUBLE),
    )
    entity(
        "nation", "Nation", "n_nationkey",
        ("rdfs:label", c("n_name"), STRING),
        ("skos:broader", _uri("region", c("n_regionkey")), "uri"),
        ("linkedTo", _uri("nation", F.pmod(7 * c("n_nationkey") + 3, F.lit(25))), "uri"),
    )
    entity("region", "Region", "r_regionkey", ("rdfs:label", c("r_name"), STRING), ("skos:broader", F.lit("world"), "uri"))
    entity(
        "part", "Part", "p_partkey",
        ("rdfs:label", c("p_name"), STRING),
        ("brand", c("p_brand"), STRING),
        ("partType", c("p_type"), STRING),
        ("size", c("p_size"), INTEGER),
        ("price", c("p_retailprice").cast("double"), DOUBLE),
    )
    entity(
        "lineitem", "Line", "_line",
        ("ofOrder", _uri("order", c("l_orderkey")), "uri"),
        ("ofPart", _uri("part", c("l_partkey")), "uri"),
        ("bySupplier", _uri("supplier", c("l_suppkey")), "uri"),
        ("quantity", c("l_quantity").cast("double"), DOUBLE),
        ("shipDate", c("l_shipdate").cast("date"), DATE),
        rows=table("lineitem").withColumn("_line", F.monotonically_increasing_id()),
    )
    entity(
        "documents", "Document", "doc_id",
        ("lang", c("lang"), STRING),
        ("source", c("source"), STRING),
        ("text", c("text"), STRING, F.coalesce(c("lang"), F.lit(""))),
    )
    by_predicate = {p: reduce(DataFrame.unionAll, branches) for p, branches in parts.items()}
    view = reduce(DataFrame.unionAll, by_predicate.values())
    view.by_predicate = by_predicate
    view.by_subject = (reduce(DataFrame.unionAll, wide), literals, links)
    return view
