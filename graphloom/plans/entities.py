"""Entity kinds as specs, and the queries that are built from them step by step.

A query is a DataFrame with a column for each variable; every step returns another one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import aggregate as agg
from graphloom.operators import pattern as pt
from graphloom.operators import schema as sc

Triple = tuple[str, str | tuple[str, ...], str]


@dataclass(frozen=True)
class Filter:
    """Patterns that a filter adds, and the variables that URIs and text restrict (None: not allowed)."""

    patterns: tuple[Triple, ...]
    uri: str | None
    text: str


@dataclass(frozen=True)
class Entity:
    """A kind of entity: its variable, its label's variable, its core patterns and its filters."""

    var: str
    label: str
    core: tuple[Triple, ...]
    filters: dict[str, Filter] = field(default_factory=dict)


#: The five kinds and their 21 filters. "?function" stands for the composer's function.
COMPOSER = "?function"
_CREATED: Triple = ("?expCreation", "efrbroo:R17_created", "?expression")
_ACTIVITY: Triple = ("?expCreation", "ecrm:P9_consists_of", "?compositionActivity")
_COMPOSER: Triple = ("?compositionActivity", "ecrm:P14_carried_out_by", "?composer")
_COUNTRY = ("schema:birthPlace", "geonames:countryCode")
_TRACK: tuple[Triple, ...] = (
    ("?track", "mus:U51_is_partial_or_full_recording_of", "?performance"),
    ("?performance", "mus:U54_is_performed_expression_of", "?work"),
)
KINDS = {
    "artist": Entity(
        "artist", "name",
        (("?artist", pt.TYPE, "ecrm:E21_Person"), ("?artist", "foaf:name", "?name")),
        {
            "name": Filter((("?artist", "foaf:name", "?name"),), "artist", "name"),
            "nationality": Filter((("?artist", _COUNTRY, "?countryCode"),), None, "countryCode"),
            "birth_place": Filter((("?artist", "schema:birthPlace", "?birthPlace"), ("?birthPlace", "geonames:name", "?birthPlaceLabel")), "birthPlace", "birthPlaceLabel"),
            "death_place": Filter((("?artist", "schema:deathPlace", "?deathPlace"), ("?deathPlace", "geonames:name", "?deathPlaceLabel")), "deathPlace", "deathPlaceLabel"),
            "work_title": Filter(
                (("?expCreation", ("ecrm:P9_consists_of", "ecrm:P14_carried_out_by"), "?artist"), ("?expCreation", "efrbroo:R17_created", "?work"), ("?work", "rdfs:label", "?workTitle")),
                None, "workTitle",
            ),
        },
    ),
    "expression": Entity(
        "expression", "title",
        (("?expression", pt.TYPE, "efrbroo:F22_Self-Contained_Expression"), ("?expression", "rdfs:label", "?title"), _CREATED),
        {
            "title": Filter((("?expression", "rdfs:label", "?title"),), None, "title"),
            "composer_name": Filter((_CREATED, _ACTIVITY, _COMPOSER, ("?compositionActivity", "mus:U31_had_function", COMPOSER), ("?composer", "foaf:name", "?composerName")), "composer", "composerName"),
            "composer_nationality": Filter((_CREATED, _ACTIVITY, _COMPOSER, ("?composer", _COUNTRY, "?countryCode")), None, "countryCode"),
            "genre": Filter((("?expression", "mus:U12_has_genre", "?expGenre"), ("?expGenre", "skos:prefLabel", "?expGenreLabel")), "expGenre", "expGenreLabel"),
            "musical_key": Filter((("?expression", "mus:U11_has_key", "?expKey"), ("?expKey", "skos:prefLabel", "?expKeyLabel")), "expKey", "expKeyLabel"),
        },
    ),
    "performance": Entity(
        "performance", "title",
        (("?performance", pt.TYPE, "efrbroo:F31_Performance"), ("?performance", "rdfs:label", "?title")),
        {
            "title": Filter((("?performance", "rdfs:label", "?title"),), None, "title"),
            "location": Filter((("?performance", "ecrm:P7_took_place_at", "?place"), ("?place", "geonames:name", "?placeName")), "place", "placeName"),
            "performer": Filter(
                (("?performance", "ecrm:P9_consists_of", "?performanceActivity"), ("?performanceActivity", "ecrm:P14_carried_out_by", "?performer"), ("?performer", "foaf:name", "?performerName")),
                "performer", "performerName",
            ),
        },
    ),
    "recording_event": Entity(
        "recordingEvent", "title",
        (("?recordingEvent", pt.TYPE, "efrbroo:F29_Recording_Event"), ("?recordingEvent", "rdfs:label", "?title")),
        {
            "title": Filter((("?recordingEvent", "rdfs:label", "?title"),), None, "title"),
            "recorded_by": Filter((("?recordingEvent", ("ecrm:P9_consists_of", "ecrm:P14_carried_out_by"), "?recorder"), ("?recorder", "foaf:name", "?recorderName")), "recorder", "recorderName"),
            "performed_by": Filter((("?recordingEvent", ("ecrm:P9_consists_of", "ecrm:P14_carried_out_by"), "?performer"), ("?performer", "foaf:name", "?performerName")), "performer", "performerName"),
            "location": Filter((("?recordingEvent", "ecrm:P7_took_place_at", "?place"), ("?place", "geonames:name", "?placeName")), "place", "placeName"),
            "recorded_performance": Filter((("?recordingEvent", "efrbroo:R20_recorded", "?performance"), ("?performance", "rdfs:label", "?performanceLabel")), None, "performanceLabel"),
        },
    ),
    "track": Entity(
        "track", "title",
        (("?track", pt.TYPE, "mus:M24_Track"), ("?track", "rdfs:label", "?title"), *_TRACK, ("?work", "rdfs:label", "?workTitle")),
        {
            "work_title": Filter((*_TRACK, ("?work", "rdfs:label", "?workTitle")), None, "workTitle"),
            "composer_name": Filter(
                (*_TRACK, ("?expCreation", "efrbroo:R17_created", "?work"), ("?expCreation", ("ecrm:P9_consists_of", "ecrm:P14_carried_out_by"), "?composer"), ("?composer", "foaf:name", "?composerName")),
                "composer", "composerName",
            ),
            "genre": Filter((*_TRACK, ("?work", "mus:U12_has_genre", "?workGenre"), ("?workGenre", "skos:prefLabel", "?workGenreLabel")), "workGenre", "workGenreLabel"),
        },
    ),
}


def _matched(triples: DataFrame, pattern: Triple) -> DataFrame:
    s, p, o = pattern
    return pt.path(triples, s, p, o) if isinstance(p, tuple) else pt.match(triples, s, p, o)


def _joined(query: DataFrame, triples: DataFrame, patterns: Sequence[Triple]) -> DataFrame:
    """query with the patterns that bring a new variable or compare with a constant.

    In a spec a pair of variables stands for one pattern, so a pattern between two columns that are there already
    has been joined by an earlier step (the core or another filter), and is not joined again.
    """
    todo = [p for p in patterns if not {v[1:] for v in (p[0], p[2]) if v.startswith("?")} <= {*query.columns} or not p[2].startswith("?")]
    while todo:
        ready = next((p for p in todo if any(v[1:] in query.columns for v in (p[0], p[2]))), None)
        if ready is None:
            raise ValueError(f"{todo[0]} shares no variable with the query")
        todo.remove(ready)
        query = pt.conjunction(query, _matched(triples, ready))
    return query


def build_query(triples: DataFrame, kind: str | Entity) -> DataFrame:
    """All entities of a kind, with the columns of its core patterns."""
    spec = _spec(kind)
    first, *rest = spec.core
    return _joined(_matched(triples, first), triples, rest)


def _spec(kind: str | Entity) -> Entity:
    if isinstance(kind, Entity):
        return kind
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    return KINDS[kind]


def apply_filter(
    query: DataFrame, triples: DataFrame, kind: str | Entity, name: str, uris: Sequence[str] = (), text: str = "", composer: str = "function/composer"
) -> DataFrame:
    """Adds a filter's patterns, and restricts by URIs, else by text in any case; by neither, binds only.

    composer: the URI of the composer's function.
    """
    spec = _spec(kind).filters.get(name)
    if spec is None:
        raise ValueError(f"{kind!r} has no filter {name!r}")
    if uris and spec.uri is None:
        raise ValueError(f"{name!r} takes text only")
    patterns = [(s, p, composer if o == COMPOSER else o) for s, p, o in spec.patterns]
    query = _joined(query, triples, patterns)
    if uris:
        return pt.values(query, spec.uri, uris)
    return query.where(pt.regex(spec.text, text)) if text else query


def component_constraint(
    query: DataFrame, triples: DataFrame, edges: DataFrame, var: str, source_class: str, target_class: str,
    uris: Sequence[str], exact_count: int | None = None, quantity: str | None = None, choice: int = 0,
) -> DataFrame:
    """Joins along the shortest schema path (or the choice-th) from the variable's class to a component's,
    and restricts the component to the URIs.

    exact_count: the node before the component must have this number as its quantity property (named, or the
    first of its class with "quantity" in its name).
    """
    paths = sc.reduce_paths(sc.simple_paths(edges, source_class, target_class)).orderBy("size", sc._path_key())
    found = paths.limit(choice + 1).collect()  # a few paths between classes
    if len(found) <= choice:
        raise ValueError(f"no path from {source_class} to {target_class}")
    steps = found[choice]["path"]
    nodes = [f"?{var}", *(f"?{var}_{i}" for i in range(1, len(steps))), f"?{var}_component"]
    for a, step, b in zip(nodes, steps, nodes[1:], strict=False):
        query = pt.conjunction(query, pt.match(triples, a, step["pred"], b))
    query = pt.values(query, nodes[-1][1:], uris)
    if exact_count is None:
        return query
    if exact_count <= 0:
        raise ValueError("exact_count must be positive")
    if quantity is None:
        own = sc.quantity_property(edges.where(F.col("source_type") == steps[-1]["src"])).first()
        if own is None:
            raise ValueError(f"{steps[-1]['src']} has no quantity")
        quantity = own["edge"]
    counted = pt.conjunction(query, pt.match(triples, nodes[-2], quantity, "?_quantity"))
    return counted.where(pt.number_filter("_quantity", "equal", exact_count)).drop("_quantity")


def filter_by_quantity(
    query: DataFrame, triples: DataFrame, var: str, property_: str, operator: str, start: str, end: str | None = None,
    begin_path: Sequence[str] = ("time:hasBeginning", "time:inXSDDate"), end_path: Sequence[str] = ("time:hasEnd", "time:inXSDDate"),
    kind: str | None = None,
) -> DataFrame:
    """Restricts by a property: kind is number, duration, date or span (None: by the property's name and bounds).

    A span goes through the property to its first and last day; range asks for containment (or, if nothing is
    inside, a beginning inside), equal for a day in the span, more and less for a later or earlier beginning.
    """
    if operator == "range" and end is None:
        raise ValueError("range needs an end")
    if kind is None:
        name = property_.lower()
        span, date = "time-span" in name or "timespan" in name, "date" in name
        kind = "span" if span else "date" if date else "duration" if str(start).startswith("P") else "number"
    if kind == "span":
        spans = pt.match(triples, f"?{var}", property_, "?_span")
        begin, last = (pt.path(triples, "?_span", p, v) for p, v in ((begin_path, "?_begin"), (end_path, "?_end")))
        solutions = pt.optional(pt.conjunction(query, spans, begin), last)
        found = {
            "range": lambda: pt.inside_or_begins(solutions, "_begin", "_end", start, end),
            "equal": lambda: solutions.where(pt.span_holds("_begin", "_end", start)),
        }.get(operator, lambda: solutions.where(pt.open_span("_begin", operator, start)))()
        return found.drop("_span", "_begin", "_end")
    solutions = pt.conjunction(query, pt.match(triples, f"?{var}", property_, "?_value"))
    if kind == "number":
        condition = pt.number_filter("_value", operator, float(start), None if end is None else float(end))
    elif kind == "duration":
        condition = pt.duration_filter("_value", operator, start, end)
    elif kind == "date":
        low, high = {"range": (start, end), "equal": (start, start), "more": (start, "9999"), "less": ("0001", start)}[operator]
        condition = pt.date_filter("_value", low, high)
    else:
        raise ValueError(f"kind must be number, duration, date or span, not {kind!r}")
    return solutions.where(condition).drop("_value")


def group_by_having(
    query: DataFrame, group_by: str, aggregated: str, function: str, logic: str | None = None, start: float | None = None,
    end: float | None = None, also_group_by: Sequence[str] = (), distinct: bool = False,
) -> DataFrame:
    """Groups with one aggregate, named value; the other variables are sampled, as <name>_sample, or join the key if named."""
    others = query.drop(aggregated) if aggregated != group_by else query
    out = agg.group_by(
        query, [group_by], {"value": agg.aggregate(function, aggregated, distinct)} | {f"{c}_sample": agg.aggregate("SAMPLE", c) for c in others.columns if c not in (group_by, *also_group_by)},
        also_group_by,
    )
    return out if logic is None else agg.having(out, "value", logic, start, end)


def add_triplet(
    query: DataFrame, triples: DataFrame, edges: DataFrame, subject: str, subject_class: str, property_: str, obj: str, obj_class: str
) -> DataFrame:
    """One more pattern; "^" in front of the property turns it round. The class must have the property."""
    inverse = property_.startswith("^")
    if not sc.class_has_property(edges, obj_class if inverse else subject_class, property_.removeprefix("^")):
        raise ValueError(f"the schema has no {property_} from {subject_class}")
    return pt.conjunction(query, pt.match(triples, subject, property_, obj))


def select_aggregate(query: DataFrame, variable: str, aggregator: str = "", keys: Sequence[str] = ()) -> DataFrame:
    """The variable itself, distinct; or its aggregate, by the keys that are selected beside it."""
    if not aggregator:
        return pt.project(query, *keys, variable)
    return agg.group_by(query, keys, {variable: agg.aggregate(aggregator, variable)})


def execute(query: DataFrame, limit: int = 10, order_by: str | None = None, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """A page of results. aggregate.page and aggregate.mask_uris add the total and the short form."""
    return agg.top(query, limit, order_by, descending, ties) if order_by else query.limit(limit)


def ensure_not_empty(query: DataFrame) -> DataFrame:
    """The query, if it has a row."""
    if not query.limit(1).count():
        raise ValueError("the query has no results")
    return query
