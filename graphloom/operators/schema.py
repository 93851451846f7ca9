"""Schema edges between classes: extraction, statistics, paths and neighbourhoods.

Every function on edges (source_type, edge, target_type) takes an edge table of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.aggregate import class_counts, first_per_group, predicate_counts
from graphloom.operators.numbering import written
from graphloom.operators.pattern import TYPE, _checkpointed, of_predicates

LITERAL = "Literal"
MAX_NODES = 6
_STEP = "array<struct<src: string, pred: string, dst: string>>"


def schema_edges(
    triples: DataFrame, literal_mode: int = 1, min_edges: int = 0, min_nodes: int = 0
) -> DataFrame:
    """Distinct (source_type, edge, target_type) of all triples with a typed subject.

    The target is each type of the object, or Literal; objects that are neither are left out. Predicates and
    classes with fewer uses than asked for are left out, Literal apart. literal_mode: 0 without literals, 1
    with them, 2 with each literal edge numbered (Literal_1 ...) by source and predicate.
    """
    if literal_mode not in (0, 1, 2):
        raise ValueError("literal_mode must be 0, 1 or 2")
    typed = of_predicates(triples, TYPE).where("o IS NOT NULL").select("s", F.col("o").alias("type"))
    if min_nodes:
        often = class_counts(triples).where(F.col("count") >= min_nodes).select(F.col("node_type").alias("type"))
        typed = typed.join(often, "type", "left_semi")
    often = predicate_counts(triples).where(F.col("count") >= min_edges).select("edge") if min_edges else None
    whole = vars(triples).get("by_subject")
    out_of = written(_out_of(triples, typed) if whole is None else _out_of_rows(*whole, typed))
    if often is not None:
        out_of = out_of.join(often, "edge", "left_semi")
    literals = out_of.where("o IS NULL").select("source_type", "edge", F.lit(LITERAL).alias("target_type")).distinct()
    resources = (
        out_of.where("o IS NOT NULL")
        .join(typed.select(F.col("s").alias("o"), F.col("type").alias("target_type")), "o")
        .select("source_type", "edge", "target_type").distinct()
    )
    # A schema's size, and what follows reads it more than once.
    resources, literals = written(resources.coalesce(1)), written(literals.coalesce(1))
    if literal_mode == 0:
        return resources
    if literal_mode == 2:  # a row for each class and predicate: a schema's size
        number = F.row_number().over(Window.orderBy("source_type", "edge"))
        literals = literals.withColumn("target_type", F.concat(F.lit(f"{LITERAL}_"), number))
    return resources.unionByName(literals)


def _out_of(triples: DataFrame, typed: DataFrame) -> DataFrame:
    """Distinct (source_type, edge, o) of a table of triples; o is null for literals."""
    edges = triples.where((F.col("p") != TYPE) & F.col("o_kind").isin("literal", "uri") & (F.col("o_kind").eqNullSafe("literal") | F.col("o").isNotNull()))
    edges = edges.select("s", F.col("p").alias("edge"), F.when(F.col("o_kind") == "uri", F.col("o")).alias("o"))
    return edges.join(typed, "s").select(F.col("type").alias("source_type"), "edge", "o").distinct()


def _out_of_rows(rows: DataFrame, literals: list[list[str]], links: list[list[str]], typed: DataFrame) -> DataFrame:
    """As _out_of, of a view's by_subject: a subject meets its types once, with all that its row of a table holds."""
    found = rows.join(typed, "s").select(F.col("type").alias("source_type"), "k", F.posexplode(F.concat(F.array(F.col("literals_").cast("string")), "links_")).alias("at", "o"))
    found = written(found.where("o IS NOT NULL").distinct())
    bits = [(k, i, p) for k, names in enumerate(literals) for i, p in enumerate(names)]
    ends = [(k, i + 1, p) for k, names in enumerate(links) for i, p in enumerate(names)]
    spark = rows.sparkSession
    bits, ends = spark.createDataFrame(bits, "k int, bit int, edge string"), spark.createDataFrame(ends, "k int, at int, edge string")
    has = found.where("at = 0").join(F.broadcast(bits), "k").where("shiftright(cast(o AS long), bit) & 1 = 1")
    has = has.select("source_type", "edge", F.lit(None).cast("string").alias("o"))
    return has.unionAll(found.where("at > 0").join(F.broadcast(ends), ["k", "at"]).select("source_type", "edge", "o"))


def inverse_arcs(edges: DataFrame, target: str) -> DataFrame:
    """Distinct (source_type, edge) that point at a class."""
    return edges.where(F.col("target_type") == target).select("source_type", "edge").distinct()


def incoming_predicates(triples: DataFrame, entity: str) -> DataFrame:
    """(p, example): predicates that point at an entity, with the least subject of each."""
    return triples.where(F.col("o") == entity).groupBy("p").agg(F.min("s").alias("example"))


def simple_paths(edges: DataFrame, source: str, target: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """(path, size): paths from source to target without a repeated node, of at most max_nodes nodes.

    Only edges on some walk of that length are followed: those whose ends are near enough to both, found by
    one distance search each way. Paths grow level by level. Source and target alike: no path.
    """
    # Once: edges may be an extraction over all triples, and every round below reads them.
    edges = _checkpointed(edges.select("source_type", "edge", "target_type").where("source_type != target_type").distinct())
    if source == target or max_nodes < 2:
        return edges.where("false").select(F.array().cast(_STEP).alias("path"), F.lit(0).alias("size"))
    steps = max_nodes - 1
    near_target = _distances(edges, "target_type", "source_type", target, steps)
    edges = _checkpointed(
        edges.join(near_target.withColumnsRenamed({"node": "target_type", "distance": "left"}), "target_type")
        .where((F.col("target_type") != source) & (F.col("source_type") != target))
    )
    step = F.struct(F.col("source_type").alias("src"), F.col("edge").alias("pred"), F.col("target_type").alias("dst"))
    level = edges.where(F.col("source_type") == source).where(F.col("left") <= steps - 1)
    level = level.select(F.array(step).alias("path"), F.array("source_type", "target_type").alias("nodes"), F.col("target_type").alias("end"))
    done = []
    for size in range(1, steps + 1):
        level = _checkpointed(level)
        done.append(level.where(F.col("end") == target).select("path", F.lit(size).alias("size")))
        if size < steps:
            grown = level.where(F.col("end") != target).join(edges, F.col("end") == F.col("source_type"))
            level = grown.where((F.col("left") <= steps - size - 1) & ~F.array_contains("nodes", F.col("target_type"))).select(
                F.concat("path", F.array(step)).alias("path"),
                F.concat("nodes", F.array("target_type")).alias("nodes"),
                F.col("target_type").alias("end"),
            )
    return reduce(DataFrame.unionByName, done)


def _distances(edges: DataFrame, from_: str, to: str, start: str, most: int) -> DataFrame:
    """(node, distance): nodes within `most` steps of the start, walking edges from one column to the other."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, distance int")
    for d in range(1, most + 1):
        next_ = edges.join(seen.where(F.col("distance") == d - 1), F.col(from_) == F.col("node"), "left_semi")
        new = next_.select(F.col(to).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        seen = _checkpointed(seen.unionByName(new))
    return seen


def _path_key() -> Column:
    return F.array_join(F.transform("path", lambda s: F.concat_ws(" ", s["src"], s["pred"], s["dst"])), " / ")


def reduce_paths(paths: DataFrame, k: int = 5) -> DataFrame:
    """Distinct paths, the k shortest of each last property, ties by text."""
    last = F.element_at("path", -1)["pred"]
    keyed = paths.select("path", "size", _path_key().alias("key"), last.alias("last")).dropDuplicates(["key"])
    return first_per_group(keyed, ["last"], ["size", "key"], k).select("path", "size", "last")


def paths_with_data(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths all of whose steps are among the edges that data has."""
    keyed = paths.withColumn("_key", _path_key())
    steps = keyed.select("_key", F.explode("path").alias("s")).select("_key", "s.*")
    have = edges.select(F.col("source_type").alias("src"), F.col("edge").alias("pred"), F.col("target_type").alias("dst"))
    missing = steps.join(have, ["src", "pred", "dst"], "left_anti").select("_key").distinct()
    return keyed.join(missing, "_key", "left_anti").drop("_key")


def k_shortest_paths(edges: DataFrame, source: str, target: str, k: int, max_nodes: int = MAX_NODES) -> DataFrame:
    """(path, size): the k shortest simple paths by number of edges, ties by text. Search ends at the size that fills k."""
    return _shortest(edges, source, target, k, max_nodes, F.lit("")).orderBy("size", _path_key()).limit(k).select("path", "size")


def shortest_by_property(
    edges: DataFrame, source: str, target: str, k: int = 5, max_nodes: int = MAX_NODES, on_level: Callable[[int, int], None] | None = None
) -> DataFrame:
    """(path, size, last): what reduce_paths keeps of simple_paths, without all of the latter being written.

    on_level: told the size and the number of open paths of each level.
    """
    return _shortest(edges, source, target, k, max_nodes, F.col("edge"), on_level)


def _shortest(
    edges: DataFrame, source: str, target: str, k: int, max_nodes: int, of: Column, on_level: Callable[[int, int], None] | None = None
) -> DataFrame:
    """(path, size, last): the k first paths, by size and text, for each value of `of` (an expression over the last edge).

    Paths grow by an edge a level from the source, only along nodes from which a wanted last edge is near enough. What has
    k paths is full, and its last edges are taken away; without any left the search ends. Of parallel edges between
    two classes the k first will do: with all else equal, the k first texts have no others.
    """
    edges = _checkpointed(edges.select("source_type", "edge", "target_type").where("source_type != target_type").distinct())
    step = F.struct(F.col("source_type").alias("src"), F.col("edge").alias("pred"), F.col("target_type").alias("dst"))
    steps = max_nodes - 1
    none = edges.where("false").select(F.array().cast(_STEP).alias("path"), F.lit(0).alias("size"), F.lit("").alias("last"))
    if source == target or steps < 1:
        return none
    last = _checkpointed(edges.where(F.col("target_type") == target).select("source_type", "edge", "target_type", of.alias("of")))
    inner = edges.where((F.col("source_type") != target) & ~F.col("target_type").isin(source, target))
    inner = _checkpointed(first_per_group(inner, ["source_type", "target_type"], ["edge"], k))
    level = edges.sparkSession.createDataFrame([([source], source)], "nodes array<string>, end string").withColumn("path", F.array().cast(_STEP))
    found, have = none, {}
    for size in range(1, steps + 1):
        whole = level.join(last, F.col("end") == F.col("source_type")).select(F.concat("path", F.array(step)).alias("path"), F.lit(size).alias("size"), "of")
        first = whole.withColumn("key", _path_key())
        first = _checkpointed(first_per_group(first, ["of"], ["key"], k).drop("key"))
        counts = dict(map(tuple, first.groupBy("of").count().collect()))  # a row for each property
        # Shorter paths come first: of these only as many as are wanted still.
        wanted = F.lit(k) - F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in have.items() for x in kv)), F.col("of")), F.lit(0)) if have else F.lit(k)
        ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("of").orderBy(_path_key()))).where(F.col("_r") <= wanted).drop("_r")
        found = found.unionByName(ranked.withColumnRenamed("of", "last"))
        for of_, n in counts.items():
            have[of_] = have.get(of_, 0) + n
        full = [of_ for of_, n in have.items() if n >= k]
        last = last.where(~F.col("of").isin(full)) if full else last
        if size == steps or last.isEmpty():
            break
        near = _near(inner, last.select(F.col("source_type").alias("node")), steps - size - 1)
        grown = level.join(inner, F.col("end") == F.col("source_type")).where(~F.array_contains("nodes", F.col("target_type")))
        grown = grown.join(near.withColumnRenamed("node", "target_type"), "target_type", "left_semi")
        level = _checkpointed(
            grown.select(F.concat("nodes", F.array("target_type")).alias("nodes"), F.col("target_type").alias("end"), F.concat("path", F.array(step)).alias("path"))
        )
        if on_level:
            on_level(size, level.count())
    return found.withColumn("last", F.try_element_at("path", F.lit(-1))["pred"])


def _near(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Nodes from which one of the nodes is at most so many edges away."""
    seen = _checkpointed(nodes.distinct())
    for _ in range(most):
        before = edges.join(seen.withColumnRenamed("node", "target_type"), "target_type", "left_semi").select(F.col("source_type").alias("node"))
        seen = _checkpointed(seen.unionAll(before).distinct())
    return seen


def neighbourhood(edges: DataFrame, cls: str, depth: int = 1) -> DataFrame:
    """Edges that touch the class, or (depth 2) one of its neighbours. Unknown classes and other depths fail."""
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    edges = edges.select("source_type", "edge", "target_type").distinct()
    touching = edges.where((F.col("source_type") == cls) | (F.col("target_type") == cls))
    if not touching.limit(1).count():
        raise ValueError(f"no edge has the class {cls!r}")
    if depth == 1:
        return touching
    seeds = touching.select(F.explode(F.array("source_type", "target_type")).alias("seed")).where(F.col("seed") != LITERAL).distinct()
    out = edges.join(seeds, F.col("source_type") == F.col("seed"), "left_semi")
    return out.unionAll(edges.join(seeds, F.col("target_type") == F.col("seed"), "left_semi")).distinct()


def summary(
    edges: DataFrame, edge_counts: DataFrame, class_counts_: DataFrame, prefixes: list[str] | None = None,
    classes: int = 15, most: int = 20, degree: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(edges among the largest classes, those classes without such an edge).

    Edges come by the predicate's frequency; a class is source of at most `degree` of them, and target of as
    many; no self-loops; `most` in all. Ties are broken by name.
    """
    large = class_counts_.where(F.col("node_type") != LITERAL)
    if prefixes is not None:
        large = large.where(F.split_part("node_type", F.lit(":"), F.lit(1)).isin(*prefixes))
    large = large.orderBy(F.desc("count"), "node_type").limit(classes).select("node_type")
    among = (
        edges.select("source_type", "edge", "target_type").distinct().where("source_type != target_type")
        .join(large.withColumnRenamed("node_type", "source_type"), "source_type", "left_semi")
        .join(large.withColumnRenamed("node_type", "target_type"), "target_type", "left_semi")
        .join(edge_counts, "edge", "left")
    )
    by = [F.desc_nulls_last("count"), "edge", "source_type", "target_type"]
    capped = first_per_group(first_per_group(among, ["source_type"], by, degree), ["target_type"], by, degree)
    shown = capped.orderBy(*by).limit(most).select("source_type", "edge", "target_type")
    ends = shown.select(F.explode(F.array("source_type", "target_type")).alias("node_type"))
    return shown, large.join(ends, "node_type", "left_anti")


def class_has_property(edges: DataFrame, cls: str, property_: str) -> bool:
    """Whether some edge of the property leaves the class. One look."""
    return bool(edges.where((F.col("source_type") == cls) & (F.col("edge") == property_)).limit(1).count())


def quantity_property(edges: DataFrame) -> DataFrame:
    """(source_type, edge): of each class its first property with "quantity" in the name."""
    return edges.where(F.lower("edge").contains("quantity")).groupBy("source_type").agg(F.min("edge").alias("edge"))


def search_terms(edges: DataFrame, term: str, kind: str = "class") -> DataFrame:
    """One column, term: names of classes or predicates with the text in them, in any case. None found fails."""
    if kind not in ("class", "predicate"):
        raise ValueError("kind must be class or predicate")
    names = F.array("source_type", "target_type") if kind == "class" else F.array("edge")
    found = edges.select(F.explode(names).alias("term")).where(F.lower("term").contains(term.lower())).distinct()
    if not found.limit(1).count():
        raise ValueError(f"no {kind} has {term!r} in its name")
    return found


def variable_classes(triples: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, domain, range): declared classes of each predicate's ends, else the least found in data."""

    def declared(predicate: str, name: str) -> DataFrame:
        return of_predicates(triples, predicate).groupBy(F.col("s").alias("edge")).agg(F.min("o").alias(name))

    found = edges.groupBy("edge").agg(
        F.min("source_type").alias("s_domain"), F.min(F.when(F.col("target_type") != LITERAL, F.col("target_type"))).alias("s_range")
    )
    out = found.join(declared("rdfs:domain", "d_domain"), "edge", "left").join(declared("rdfs:range", "d_range"), "edge", "left")
    return out.select("edge", F.coalesce("d_domain", "s_domain").alias("domain"), F.coalesce("d_range", "s_range").alias("range"))
