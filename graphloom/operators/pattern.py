"""Graph patterns over triples: scans, joins, paths, closures, filters and set operations.

A variable is a string that begins with "?"; it names a column of the result, without the "?". Other strings
are constants. Patterns bind variables to the text of terms, and never to null.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.numbering import written
from graphloom.sources.shared import shared_folder

TYPE = "rdf:type"
#: Members of a block of a large group.
BLOCK_MEMBERS = 2_000
#: Rows of a task aimed at, where a step has to hold or sort its rows.
TASK_ROWS = 500_000
#: Values that go into the plan as a list; more are joined as a table.
INLINE_VALUES = 1_000


def _is_var(term: str) -> bool:
    return term.startswith("?")


def _checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the folder that the cluster shares (spark.checkpoint.dir)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def of_predicates(triples: DataFrame, *names: str) -> DataFrame:
    """The triples of the named predicates. Of a view that has its predicates apart, in a mapping by_predicate, only
    those tables go into the plan; what is derived from such a view by Spark's own functions is filtered as any table."""
    apart = vars(triples).get("by_predicate")
    if apart is None:
        return triples.where(F.col("p") == names[0] if len(names) == 1 else F.col("p").isin(*names))
    found = [apart[n] for n in dict.fromkeys(names) if n in apart]
    return reduce(DataFrame.unionAll, found) if found else triples.where(F.lit(False))


def match(triples: DataFrame, s: str, p: str | Sequence[str], o: str) -> DataFrame:
    """One triple pattern.

    p is a predicate, "^" and a predicate for the inverse, a list of predicates for alternatives, or a
    variable. A variable that occurs twice asks for equal terms. Nulls match nothing.
    """
    if isinstance(p, str) and p.startswith("^"):
        return match(triples, o, p[1:], s)
    ends = [("s", s), ("o", o)]
    if isinstance(p, str) and _is_var(p):
        ends.insert(1, ("p", p))
    else:
        triples = of_predicates(triples, *([p] if isinstance(p, str) else p))
    columns: dict[str, Column] = {}
    for column, term in ends:
        if not _is_var(term):
            triples = triples.where(F.col(column) == term)
        elif term[1:] in columns:
            triples = triples.where(F.col(column) == columns[term[1:]])
        else:
            columns[term[1:]] = F.col(column)
            triples = triples.where(F.col(column).isNotNull())
    if not columns:
        raise ValueError("a pattern needs a variable")
    return triples.select(*(c.alias(name) for name, c in columns.items()))


def instances(triples: DataFrame, var: str, cls: str) -> DataFrame:
    """The distinct instances of a class."""
    return match(triples, var, TYPE, cls).distinct()


def conjunction(*patterns: DataFrame) -> DataFrame:
    """Natural inner join on all shared columns, in the order given.

    A pattern that shares no column with those before it would be a cross join, and is refused.
    """

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError(f"{right.columns} shares no column with {left.columns}")
        return left.join(right, shared)

    return reduce(join, patterns)


def without(solutions: DataFrame, *names: str) -> DataFrame:
    """Solutions without the columns of anonymous nodes."""
    return solutions.drop(*names)


def path(triples: DataFrame, s: str, steps: Sequence[str | Sequence[str]], o: str) -> DataFrame:
    """Sequence path; each step as p of match. The nodes between are dropped, multiplicities stay."""
    nodes = [s, *(f"?_{i}" for i in range(1, len(steps))), o]
    found = conjunction(*(match(triples, a, p, b) for a, p, b in zip(nodes, steps, nodes[1:], strict=False)))
    return found.drop(*(n[1:] for n in nodes[1:-1]))


def closure(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """P10: (start, node) for every node that a start reaches over zero or more edges.

    edges: (s, o); starts: one column. Each round joins the newest pairs with the edges, and writes those not seen
    yet, so cycles end it; as many rounds as the longest shortest path. Nulls are ignored.
    """
    edges = edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct()
    start = starts.columns[0]
    newest = _checkpointed(
        starts.where(F.col(start).isNotNull()).select(F.col(start).alias("start"), F.col(start).alias("node")).distinct()
    )
    seen, rounds = newest, 0
    while max_rounds is None or rounds < max_rounds:
        reached = newest.join(edges, F.col("node") == F.col("s")).select("start", F.col("o").alias("node")).distinct()
        newest = _checkpointed(reached.join(seen, ["start", "node"], "left_anti"))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
        rounds += 1
    return seen


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (s, o), read in either direction: the least node that it reaches.

    Rounds of the neighbours' least label, each followed by the label's own label, so that they grow with the logarithm
    of the longest chain as a rule. Minima are combined before the shuffle. Nulls are ignored.
    """
    links = links.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL")
    both = _checkpointed(links.unionAll(links.select("o", "s")).distinct())
    labels = both.groupBy(F.col("s").alias("node")).agg(F.min("o").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels, before = _checkpointed(labels), None
    while True:
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
        near = both.join(labels.withColumnRenamed("node", "o"), "o").groupBy(F.col("s").alias("node")).agg(F.min("component").alias("near"))
        next_ = _checkpointed(labels.join(near, "node").select("node", F.least("component", "near").alias("component")))
        of_label = next_.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = _checkpointed(next_.join(of_label, "component").select("node", F.col("further").alias("component")))


def values(solutions: DataFrame, var: str, wanted: Iterable) -> DataFrame:
    """Solutions whose variable is one of the wanted values. No values leave no solutions."""
    wanted = list(dict.fromkeys(wanted))
    if len(wanted) <= INLINE_VALUES:
        return solutions.where(F.col(var).isin(wanted)) if wanted else solutions.where(F.lit(False))
    table = solutions.sparkSession.createDataFrame([(w,) for w in wanted], [var])
    return solutions.join(table, var, "left_semi").select(*solutions.columns)


def all_of(solutions: DataFrame, *conditions: Column) -> DataFrame:
    """Solutions that fulfil all conditions."""
    return reduce(DataFrame.where, conditions, solutions)


def regex(var: str, pattern: str) -> Column:
    """The pattern occurs, in any case."""
    return F.col(var).rlike(f"(?i){pattern}")


def contains(var: str, text: str) -> Column:
    """P14."""
    return terms.lexical(F.col(var)).contains(text)


def number_filter(var: str, operator: str, start: float, end: float | None = None) -> Column:
    """Operator is less, more, equal or range; all with their bounds. Text that is no number fails."""
    value = terms.number(F.col(var))
    return _compare(value, operator, start, end)


def _compare(value: Column, operator: str, start, end=None) -> Column:
    if operator == "range":
        if end is None:
            raise ValueError("range needs an end")
        return value.between(start, end)
    try:
        return {"less": value <= start, "more": value >= start, "equal": value == start}[operator]
    except KeyError:
        raise ValueError(f"operator must be less, more, equal or range, not {operator!r}") from None


def inside(begin: str, end: str, low: str, high: str) -> Column:
    """A span with first day >= low and last day <= high. Columns and bounds are date texts."""
    return (terms.first_day(F.col(begin)) >= terms.first_day(F.lit(low))) & (
        terms.last_day(F.col(end)) <= terms.last_day(F.lit(high))
    )


def inside_or_begins(solutions: DataFrame, begin: str, end: str, low: str, high: str) -> DataFrame:
    """Solutions whose span is inside; if there are none, those whose begin is. One look decides."""
    strict = solutions.where(inside(begin, end, low, high))
    return strict if strict.limit(1).count() else solutions.where(inside(begin, begin, low, high))


def span_holds(begin: str, end: str, day: str) -> Column:
    """The span has the day (of a year: all of it, from its first to its last day)."""
    return (terms.first_day(F.col(begin)) <= terms.first_day(F.lit(day))) & (
        terms.last_day(F.col(end)) >= terms.last_day(F.lit(day))
    )


def open_span(begin: str, operator: str, day: str) -> Column:
    """P20, Q1: "more" begins after the day, "less" before it."""
    if operator not in ("less", "more"):
        raise ValueError(f"operator must be less or more, not {operator!r}")
    value = terms.first_day(F.col(begin))
    return value > terms.last_day(F.lit(day)) if operator == "more" else value < terms.first_day(F.lit(day))


def duration_filter(var: str, operator: str, start: str, end: str | None = None) -> Column:
    """As number_filter, on ISO-8601 durations."""
    bound = [terms.duration_seconds(F.lit(x)) for x in (start, end) if x is not None]
    return _compare(terms.duration_seconds(F.col(var)), operator, *bound)


def date_filter(var: str, low: str, high: str) -> Column:
    """A date property between two dates or years, both included."""
    return terms.first_day(F.col(var)).between(terms.first_day(F.lit(low)), terms.last_day(F.lit(high)))


def years_apart(later: str, earlier: str, most: int) -> Column:
    """Difference of calendar years, at most `most`."""
    return F.year(terms.first_day(F.col(later))) - F.year(terms.first_day(F.col(earlier))) <= most


def language_filter(triples: DataFrame, only_english: Sequence[str] = ("rdfs:comment",)) -> DataFrame:
    """Values of the named predicates only in English; all other values."""
    return triples.where(~F.col("p").isin(*only_english) | (F.col("o_lang") == "en"))


def optional(solutions: DataFrame, pattern: DataFrame) -> DataFrame:
    """P25: left outer natural join."""
    return solutions.join(pattern, _shared(solutions, pattern), "left")


def union(*patterns: DataFrame) -> DataFrame:
    """All solutions; variables that a pattern lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), patterns)


def minus(solutions: DataFrame, pattern: DataFrame) -> DataFrame:
    """Solutions that agree with none of the pattern's on the shared variables.

    Without shared variables nothing is removed. A null key agrees with nothing here, so such rows stay.
    """
    shared = [c for c in solutions.columns if c in pattern.columns]
    return solutions.join(pattern.select(*shared).distinct(), shared, "left_anti") if shared else solutions


def not_exists(solutions: DataFrame, pattern: DataFrame) -> DataFrame:
    """Solutions without a match of the pattern, which must share a variable."""
    return solutions.join(pattern, _shared(solutions, pattern), "left_anti")


def exists(solutions: DataFrame, pattern: DataFrame) -> DataFrame:
    """Solutions with a match, each once however many there are."""
    return solutions.join(pattern, _shared(solutions, pattern), "left_semi")


def _shared(solutions: DataFrame, pattern: DataFrame) -> list[str]:
    shared = [c for c in solutions.columns if c in pattern.columns]
    if not shared:
        raise ValueError("the patterns share no variable")
    return shared


def bind(solutions: DataFrame, **columns: Column) -> DataFrame:
    """Computed columns."""
    return solutions.withColumns(columns)


def project(solutions: DataFrame, *names: str, distinct: bool = True) -> DataFrame:
    """The named columns (all if none are named), distinct unless told otherwise."""
    out = solutions.select(*names) if names else solutions
    return out.distinct() if distinct else out


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or more where tasks would have over TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def pairs_in_group(
    members: DataFrame, group: str, member: str, shared: str, block: int = BLOCK_MEMBERS, tasks: int | None = None
) -> DataFrame:
    """(group, shared, a, b), a < b, of members of one group that share a value.

    A group's pairs are its square. Groups of more than `block` members are cut into blocks, each pair of which, and each
    block with itself, is a cell of a triangle and joined by itself: a cell has at most about block^2 pairs, so the
    cells of one large group spread over tasks evenly. Nulls pair with nothing. The distinct members are written once, and
    shuffles follow their number, so that a task's share does not grow with the table. tasks: partitions for the members
    as they come, by default the session's number.
    """
    rows = members.select(group, member, shared).where(F.col(member).isNotNull())
    rows = written((rows if tasks is None else rows.repartition(tasks, group, member, shared)).distinct())
    n = tasks_for(rows.sparkSession, rows.count())
    large = rows.repartition(n, group, shared).groupBy(group, shared).agg(F.count(member).alias("_n")).where(F.col("_n") > block)
    large = large.select(group, shared, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = rows.join(large, [group, shared], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    own = F.col("_own")
    left = dealt.select(group, shared, F.col(member).alias("_x"), own.alias("_i"), F.explode(F.sequence(own, F.col("_blocks") - 1)).alias("_j"))
    right = dealt.select(group, shared, F.col(member).alias("_y"), own.alias("_j"), F.explode(F.sequence(F.lit(0), own)).alias("_i"))
    by = [group, shared, "_i", "_j"]
    met = left.repartition(n, *by).join(right.repartition(n, *by), by).where((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    return met.select(group, shared, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def exactly_members(members: DataFrame, group: str, member: str, wanted: Sequence) -> DataFrame:
    """Groups whose distinct members are the wanted ones, no more and no fewer."""
    wanted = list(dict.fromkeys(wanted))
    is_wanted = F.col(member).isin(wanted) if wanted else F.lit(False)
    counted = members.select(group, member).distinct().groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(is_wanted).alias("hits")
    )
    return counted.where((F.col("n") == len(wanted)) & (F.col("hits") == len(wanted))).select(group)
