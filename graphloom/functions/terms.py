"""Names, dates, durations, numbers and languages of terms, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of public vocabularies.
PREFIXES = {
    "ecrm": "http://erlangen-crm.org/current/",
    "efrbroo": "http://erlangen-crm.org/efrbroo/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "modsrdf": "http://www.loc.gov/standards/mods/rdf/v1/#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "geonames": "http://www.geonames.org/ontology#",
    "time": "http://www.w3.org/2006/time#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dbpprop": "http://dbpedia.org/property/",
    "schema": "http://schema.org/",
}
#: Prefix by a part of the namespace, in order of trial; None shows no prefix.
LABEL_HINTS = {"iaml": "iaml", "frbroo": None, "erlangen": "ecrm", "rdf": "rdf", "rdfs": "rdfs", "skos": "skos", "foaf": "foaf"}
#: Weights of languages in the weighted choice of a label.
LANGUAGE_WEIGHTS = {"en": 1.0, "en-gb": 0.8, "fr": 0.6}
OTHER_LANGUAGE = 0.1


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    chain = reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None)
    return chain.otherwise(otherwise) if cases and otherwise is not None else chain if cases else otherwise


def expand(name: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """`prefix:local` to the full URI, without angle brackets; unknown prefixes and full URIs stay."""
    bare = F.regexp_replace(name, "^<|>$", "")
    cases = [(bare.startswith(f"{p}:"), F.concat(F.lit(uri), F.substr(bare, F.lit(len(p) + 2)))) for p, uri in prefixes.items()]
    return _first(cases, bare)


def contract(uri: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """full URI to `prefix:local` by the first namespace that fits; others stay."""
    return F.coalesce(contract_known(uri, prefixes), uri)


def contract_known(uri: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """as contract, but null where no namespace fits."""
    return _first([(uri.startswith(ns), F.concat(F.lit(f"{p}:"), F.substr(uri, F.lit(len(ns) + 1)))) for p, ns in prefixes.items()])


def short_label(uri: Column, hints: Mapping[str, str | None] = LABEL_HINTS) -> Column:
    """local name of a property, with the prefix that a part of its URI hints at."""
    local = F.regexp_extract(uri, "[^#/]*$", 0)
    return _first([(uri.contains(part), F.concat(F.lit(f"{p}:"), local) if p else local) for part, p in hints.items()], local)


def first_day(text: Column) -> Column:
    """First day of YYYY, DD-MM-YYYY or YYYY-MM-DD; null for other text and impossible dates."""
    return _day(text, "-01-01")


def last_day(text: Column) -> Column:
    """Last day of YYYY; the day itself of the other two forms."""
    return _day(text, "-12-31")


def _day(text: Column, rest: str) -> Column:
    text = F.trim(text)
    year = F.when(text.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit(rest)), "yyyy-MM-dd"))
    return F.coalesce(
        year,
        F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), F.try_to_date(text, "dd-MM-yyyy")),
    )


_DURATION = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def is_duration(text: Column) -> Column:
    """whether text is an ISO-8601 duration with at least one part, years and months included."""
    return text.rlike(r"^P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")


def duration_seconds(text: Column) -> Column:
    """seconds of an ISO-8601 duration of days and less; null for years, months and other text."""

    def part(i: int, seconds: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _DURATION, i), F.lit("")).cast("double"), F.lit(0.0)) * seconds

    fits = text.rlike(_DURATION) & is_duration(text)
    return F.when(fits, part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1))


def language_priority(lang: Column) -> Column:
    """1 for English, 2 for no language, 3 for others."""
    return F.when(lang == "en", 1).when(F.coalesce(lang, F.lit("")) == "", 2).otherwise(3)


def language_weight(lang: Column, weights: Mapping[str, float] = LANGUAGE_WEIGHTS, other: float = OTHER_LANGUAGE) -> Column:
    """weight of a language in a preference list."""
    return _first([(F.lower(lang) == name, F.lit(float(w))) for name, w in weights.items()], F.lit(float(other)))


def is_literal(kind: Column) -> Column:
    """F15."""
    return kind == "literal"


def lexical(value: Column) -> Column:
    """F16: the text of a term."""
    return value.cast("string")


def is_plain_number(text: Column) -> Column:
    """digits with at most one dot and no sign."""
    return text.rlike(r"^[0-9]*\.?[0-9]*$") & text.rlike("[0-9]")


def number(text: Column) -> Column:
    """the text as a double; null where it is none."""
    return text.try_cast("double")


def year(value: Column) -> Column:
    """F05."""
    return F.year(value)


def bound_flag(value: Column) -> Column:
    """1 if bound, else 0."""
    return value.isNotNull().cast("int")


def or_default(value: Column, default) -> Column:
    """F08."""
    return F.coalesce(value, F.lit(default))


def length_difference(a: Column, b: Column) -> Column:
    """absolute difference of lengths in characters."""
    return F.abs(F.char_length(a) - F.char_length(b))


def prefixed_key(priority: Column, text: Column) -> Column:
    """one digit in front of the text, so that the least key has the best priority."""
    return F.concat(priority.cast("string"), text)


def without_key(key: Column) -> Column:
    """the text of a prefixed_key."""
    return F.substr(key, F.lit(2))
