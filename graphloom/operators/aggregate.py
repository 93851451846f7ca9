"""Grouping, having, ranking and paging of solutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.numbering import numbered
from graphloom.operators.pattern import TYPE, of_predicates

#: The aggregators that queries may name.
AGGREGATORS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE")
URI = "http"


def aggregate(function: str, var: str, distinct: bool = True) -> Column:
    """One of AGGREGATORS. COUNT is distinct unless told otherwise (Q3); SAMPLE is the least value,
    so that results do not depend on the order of rows. SUM and AVG read text as numbers and skip other text."""
    column, number = F.col(var), terms.number(F.col(var))
    try:
        return {
            "COUNT": F.count_distinct(column) if distinct else F.count(column),
            "SUM": F.sum(number),
            "AVG": F.avg(number),
            "MIN": F.min(column),
            "MAX": F.max(column),
            "SAMPLE": F.min(column),
        }[function.upper()]
    except KeyError:
        raise ValueError(f"{function!r} is none of {', '.join(AGGREGATORS)}") from None


def group_by(
    solutions: DataFrame,
    keys: Sequence[str],
    aggregates: dict[str, Column],
    also_group_by: Sequence[str] = (),
    sample_others: bool = False,
) -> DataFrame:
    """Groups by the keys; no keys give one row.

    also_group_by joins further variables to the key; sample_others adds the least value of each variable that
    is neither key nor aggregated, as <name>_sample.
    """
    keys = [*keys, *also_group_by]
    out = dict(aggregates)
    if sample_others:
        out |= {f"{c}_sample": F.min(c) for c in solutions.columns if c not in keys and f"{c}_sample" not in out}
    columns = [c.alias(name) for name, c in out.items()]
    if not columns:
        return solutions.select(*keys).distinct()
    return solutions.groupBy(*keys).agg(*columns) if keys else solutions.agg(*columns)


def having(grouped: DataFrame, column: str, logic: str, start: float, end: float | None = None) -> DataFrame:
    """Logic is less, more (both strict), equal, or range (with both ends)."""
    value = F.col(column)
    if logic == "range":
        if end is None:
            raise ValueError("range needs an end")
        return grouped.where(value.between(start, end))
    try:
        return grouped.where({"less": value < start, "more": value > start, "equal": value == start}[logic])
    except KeyError:
        raise ValueError(f"logic must be less, more, equal or range, not {logic!r}") from None


def count_equals_key(solutions: DataFrame, keys: Sequence[str], counted: str, expected: str) -> DataFrame:
    """Groups by keys and `expected` in which as many values are counted as `expected` says."""
    grouped = solutions.groupBy(*keys, expected).agg(F.count(counted).alias("n"))
    return grouped.where(F.col("n") == F.col(expected)).drop("n")


def joined_types(triples: DataFrame) -> DataFrame:
    """(s, types): each entity's types, sorted and joined by " & "."""
    typed = of_predicates(triples, TYPE).where("o IS NOT NULL")
    return typed.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("o")), " & ").alias("types"))


def best_label(labels: DataFrame, keys: Sequence[str], text: str, lang: str) -> DataFrame:
    """Of each group the least label of the best language (English, none, others)."""
    key = terms.prefixed_key(terms.language_priority(F.col(lang)), F.col(text))
    return labels.where(F.col(text).isNotNull()).groupBy(*keys).agg(terms.without_key(F.min(key)).alias(text))


def heaviest_label(labels: DataFrame, keys: Sequence[str], text: str, lang: str) -> DataFrame:
    """of each group the label of the language with most weight; ties go to the least text."""
    key = F.struct(-terms.language_weight(F.col(lang)), F.col(text).alias("text"))
    return labels.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.min(key).alias("k")).select(*keys, F.col("k.text").alias(text))


def predicate_counts(triples: DataFrame) -> DataFrame:
    """(edge, count), most frequent first."""
    return triples.groupBy(F.col("p").alias("edge")).count().orderBy(F.desc("count"), "edge")


def class_counts(triples: DataFrame) -> DataFrame:
    """(node_type, count), most frequent first."""
    typed = of_predicates(triples, TYPE)
    return typed.groupBy(F.col("o").alias("node_type")).count().orderBy(F.desc("count"), "node_type")


def order(solutions: DataFrame, by: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """By one variable, then by `ties` for a definite order."""
    return solutions.orderBy(F.desc(by) if descending else F.asc(by), *ties)


def top(solutions: DataFrame, k: int, by: str, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The first k; planned as a top-k in each partition, not as a full sort."""
    return order(solutions, by, descending, ties).limit(k)


def page(solutions: DataFrame, key: str, limit: int = 10, count_to: int = 100) -> tuple[DataFrame, str]:
    """A page, and the number of distinct keys, "100+" from count_to on. Counting stops there."""
    total = solutions.select(key).where(F.col(key).isNotNull()).distinct().limit(count_to).count()
    return solutions.limit(limit), f"{count_to}+" if total >= count_to else str(total)


def mask_uris(page_rows: DataFrame, by: Sequence[str], look: int = 5, keep: int = 2) -> DataFrame:
    """Columns with a URI in the first `look` rows are blank from row keep + 1 on.

    `by` gives a definite order; rows of any number are numbered by ranges of it (see numbering.numbered).
    """
    ranked = numbered(page_rows, by, "_n").withColumn("_n", F.col("_n").cast("int"))
    names = page_rows.columns
    is_uri = {c: F.coalesce(F.col(c).cast("string").startswith(URI), F.lit(False)) for c in names}
    seen = ranked.where(F.col("_n") <= look).agg(*(F.coalesce(F.max(is_uri[c]), F.lit(False)).alias(f"_u_{c}") for c in names))
    flags = seen.first()  # one row
    return ranked.select(
        *(
            (F.when(F.col("_n") > keep, F.lit("")).otherwise(F.col(c)) if flags[f"_u_{c}"] else F.col(c)).alias(c)
            for c in names
        ),
        F.col("_n").alias("row"),
    )


def rows_between(solutions: DataFrame, by: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """O04 at any offset: `limit` rows after the first `offset` in the order of `by`, which gives a definite order.

    Rows are numbered by ranges, so that neither the driver nor one task reads what is left out; they come sorted.
    """
    found = numbered(solutions, by, "_n").where(F.col("_n").between(offset + 1, offset + limit))
    return found.orderBy("_n").select(*solutions.columns)


def keep_first(solutions: DataFrame, keys: Sequence[str], by: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; `by` gives a definite order."""
    return first_per_group(solutions, keys, by, 1)


def first_per_group(solutions: DataFrame, keys: Sequence[str], by: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group. Partitions drop all but their own first k before the shuffle."""
    ranked = solutions.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
