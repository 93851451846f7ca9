"""Search for entities by name, their labels, profiles and equivalents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.aggregate import best_label, first_per_group
from graphloom.operators.pattern import TYPE, components, of_predicates

#: Label predicate by type of entity.
LABEL_PREDICATES = {"artist": "foaf:name", "vocabulary": "skos:prefLabel", "place": "geonames:name", "others": "rdfs:label"}
#: Label predicates of any entity, and predicates that link equivalent ones.
LABELS = ("rdfs:label", "skos:prefLabel", "foaf:name")
EQUIVALENT = ("skos:exactMatch", "owl:sameAs")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def candidates(triples: DataFrame, name: str, entity_type: str = "others", limit: int | None = 15) -> DataFrame:
    """(entity, label, type, score), best first.

    Labels of the type's predicate match when they have all words of the name. A match scores the share of the
    label's words that the name has; by entity and type the label of the best language stands, with the best
    score, divided by one more than the difference in length. Entities without a type are not found.
    """
    if not name.strip():
        raise ValueError("name must not be empty")
    predicate = LABEL_PREDICATES.get(entity_type)
    if predicate is None:
        raise ValueError(f"entity_type must be one of {', '.join(LABEL_PREDICATES)}, not {entity_type!r}")
    wanted = _tokens(F.lit(name))
    words = _tokens(F.col("label"))
    labels = of_predicates(triples, predicate).select(F.col("s").alias("entity"), F.col("o").alias("label"), "o_lang")
    hits = labels.where(F.size(F.array_except(wanted, words)) == 0).where(F.size(wanted) > 0)
    hits = hits.withColumn("share", F.size(wanted) / F.size(words))
    types = of_predicates(triples, TYPE).select(F.col("s").alias("entity"), F.col("o").alias("type"))
    key = terms.prefixed_key(terms.language_priority(F.col("o_lang")), F.col("label"))
    best = hits.join(types, "entity").groupBy("entity", "type").agg(
        terms.without_key(F.min(key)).alias("label"), F.max("share").alias("share")
    )
    score = F.col("share") / (terms.length_difference(F.col("label"), F.lit(name)) + 1)
    ranked = best.select("entity", "label", "type", score.alias("score")).orderBy(F.desc("score"), "entity", "type")
    return ranked if limit is None else ranked.limit(limit)


def candidates_or_any(triples: DataFrame, name: str, entity_type: str, limit: int = 15) -> DataFrame:
    """Candidates of the type, or of "others" if there are none."""
    found = candidates(triples, name, entity_type, limit)
    return found if entity_type == "others" or found.limit(1).count() else candidates(triples, name, "others", limit)


def labels_of(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(s, label): the preferred label of each entity, of all predicates in LABELS, by language.

    entities: a table with a column s to look up; None for all.
    """
    labels = of_predicates(triples, *LABELS).select("s", F.col("o").alias("label"), "o_lang")
    if entities is not None:
        labels = labels.join(entities.select("s"), "s", "left_semi")
    return best_label(labels, ["s"], "label", "o_lang")


def resolve(triples: DataFrame, names: DataFrame, entity_type: str = "others") -> DataFrame:
    """(name, entity, label, score): the best match of each name, null where there is none (use text then).

    names: one column, name. Names and labels meet by a word, the name's rarest, so that frequent words do not
    bring together most of both tables.
    """
    names = names.select("name").where("trim(name) != ''").distinct()
    labels = of_predicates(triples, LABEL_PREDICATES[entity_type]).select(F.col("s").alias("entity"), F.col("o").alias("label"))
    by_word = labels.select("entity", "label", F.explode(_tokens(F.col("label"))).alias("word"))
    frequency = by_word.groupBy("word").agg(F.count("*").alias("n"))
    asked = names.select("name", F.explode(_tokens(F.col("name"))).alias("word")).join(frequency, "word", "left")
    rarest = asked.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("k")).select("name", "k.word")
    wanted, words = _tokens(F.col("name")), _tokens(F.col("label"))
    hits = rarest.join(by_word, "word").where(F.size(F.array_except(wanted, words)) == 0)
    score = F.size(wanted) / F.size(words) / (terms.length_difference(F.col("label"), F.col("name")) + 1)
    best = first_per_group(hits.select("name", "entity", "label", score.alias("score")), ["name"], [F.desc("score"), "entity", "label"], 1)
    return names.join(best, "name", "left")


def profile(
    triples: DataFrame, entities: DataFrame, prefixes: Sequence[str] | None = None, most_values: int = 50
) -> DataFrame:
    """(s, label, type, p, objects): of each entity its properties, with values and their labels.

    Only predicates with one of the prefixes (None: all) are shown; comments only in English. Of each property
    the first `most_values` values stand in the array, by value.
    """
    wanted = entities.select("s").distinct()
    own = triples.join(wanted, "s", "left_semi")
    shown = own.where((F.col("p") != "rdfs:comment") | (F.col("o_lang") == "en"))
    if prefixes is not None:
        shown = shown.where(F.split_part("p", F.lit(":"), F.lit(1)).isin(*prefixes))
    types = own.where(F.col("p") == TYPE).groupBy("s").agg(F.min("o").alias("type"))
    value_labels = labels_of(triples, shown.where("o_kind = 'uri'").select(F.col("o").alias("s"))).withColumnsRenamed(
        {"s": "o", "label": "o_label"}
    )
    values = shown.where((F.col("p") != TYPE) & ~F.col("p").isin(*LABELS)).join(value_labels, "o", "left")
    first = first_per_group(values.select("s", "p", "o", "o_label").distinct(), ["s", "p"], ["o"], most_values)
    objects = F.array_sort(F.collect_list(F.struct("o", "o_label"))).alias("objects")
    return (
        first.groupBy("s", "p").agg(objects).join(labels_of(triples, wanted), "s", "left").join(types, "s", "left")
        .select("s", "label", "type", "p", "objects")
    )


def equivalents(triples: DataFrame, entities: DataFrame, predicates: Sequence[str] = EQUIVALENT, most: int | None = 10) -> DataFrame:
    """(start, node): what equivalence in either direction reaches; the entity itself first, `most` at most.

    Equivalents are components, so each start meets the first `most` nodes of its own: a large component costs its
    nodes, not their pairs. With most=None all pairs of a start and a node are given.
    """
    links = of_predicates(triples, *predicates).where(F.col("s") != F.col("o")).select("s", "o")
    parts = components(links)
    start = F.col(entities.columns[0])
    starts = entities.where(start.isNotNull()).select(start.alias("start")).distinct()
    nodes = parts if most is None else first_per_group(parts, ["component"], ["node"], most)
    own = starts.join(parts, F.col("start") == F.col("node")).select("start", "component")
    others = own.join(nodes, "component").where("start != node").select("start", "node")
    found = starts.select("start", F.col("start").alias("node")).unionByName(others)
    return found if most is None else first_per_group(found, ["start"], [F.col("start") != F.col("node"), "node"], most)


def preferred_equivalents(found: DataFrame, namespace: str, most: int = 4) -> DataFrame:
    """Of each start the nodes in the namespace, `most` at most; the start itself if there are none."""
    inside = F.col("node").startswith(namespace)
    any_inside = F.max(inside).over(Window.partitionBy("start"))
    kept = found.withColumn("_any", any_inside).where(F.when(F.col("_any"), inside).otherwise(F.col("node") == F.col("start"))).drop("_any")
    return first_per_group(kept, ["start"], [F.col("start") != F.col("node"), "node"], most)


def expand_restriction(triples: DataFrame, entities: DataFrame, namespace: str, most: int | None = 10) -> DataFrame:
    """One column, node: the entities or their preferred equivalents, to restrict a pattern with. most: as for equivalents."""
    return preferred_equivalents(equivalents(triples, entities, most=most), namespace).select("node").distinct()


def unknown_uris(triples: DataFrame, uris: Iterable[str], namespace: str) -> DataFrame:
    """One column, uri: those in the namespace that no triple has. Others pass unseen."""
    asked = triples.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(uris)], "uri string").where(
        F.col("uri").startswith(namespace)
    )
    known = triples.select(F.explode(F.array("s", F.when(F.col("o_kind") == "uri", F.col("o")))).alias("uri"))
    return asked.join(known.where(F.col("uri").startswith(namespace)), "uri", "left_anti")
