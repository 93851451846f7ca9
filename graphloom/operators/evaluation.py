"""Scores of answers, and metrics over recorded runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.numbering import written

#: Tools that only explore, and the text of errors that are no schema errors.
EXPLORATORY = ("find_candidate_entities", "get_entity_properties", "get_usage_guide")
DRY_RUN = "Dry Run"
#: Calls of a trace that are followed in one go.
CHUNK_CALLS = 1_000
#: Most hops of easy and of medium queries.
EASY_HOPS, MEDIUM_HOPS = 5, 13


def uri_columns(cells: DataFrame) -> DataFrame:
    """(question_id, col): columns of a result set, cells(question_id, row_id, col, value), with a value that
    begins with http."""
    return cells.groupBy("question_id", "col").agg(F.max(F.col("value").startswith("http")).alias("u")).where("u").select("question_id", "col")


def _uris(cells: DataFrame) -> DataFrame:
    """Distinct non-empty values of URI columns."""
    return cells.where("value != ''").join(uri_columns(cells), ["question_id", "col"], "left_semi").select("question_id", "value").distinct()


def _overlap(produced: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, accuracy, n): share of the produced values that are expected; no row without produced ones."""
    marked = produced.join(expected.withColumn("hit", F.lit(1)), ["question_id", "value"], "left")
    return marked.groupBy("question_id").agg(F.round(F.count("hit") / F.count("*"), 3).alias("accuracy"))


def answer_accuracy(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(question_id, accuracy) for each question of either side.

    Shares of produced URIs that are expected, to three places. Where a side has no URI all values count
    instead, and nothing produced scores 1 if nothing is expected, else 0.
    """
    questions = expected.select("question_id").union(produced.select("question_id")).distinct()
    uris = [_uris(x) for x in (produced, expected)]
    both = uris[0].select("question_id").intersect(uris[1].select("question_id"))
    by_uri = _overlap(uris[0].join(both, "question_id", "left_semi"), uris[1])
    rest = questions.join(both, "question_id", "left_anti")
    every = [x.where("value != ''").select("question_id", "value").distinct() for x in (produced, expected)]
    by_value = _overlap(every[0].join(rest, "question_id", "left_semi"), every[1])
    asked = every[1].select("question_id").distinct().withColumn("asked", F.lit(True))
    fallback = rest.join(by_value, "question_id", "left").join(asked, "question_id", "left")
    fallback = fallback.select("question_id", F.coalesce("accuracy", F.when(F.col("asked"), 0.0).otherwise(1.0)).alias("accuracy"))
    return by_uri.unionByName(fallback)


def schema_errors(calls: DataFrame) -> DataFrame:
    """(trace_id, errors): calls(trace_id, seq, name, status, content) that failed, dry runs apart."""
    failed = (F.col("status") == "error") & ~F.coalesce(F.col("content").contains(DRY_RUN), F.lit(False))
    return calls.groupBy("trace_id").agg(F.count_if(failed).alias("errors"))


def workflow_drift(calls: DataFrame, workflows: DataFrame, chunk: int = CHUNK_CALLS) -> DataFrame:
    """(trace_id, errors) for each of workflows(trace_id, steps array<string>): how far calls stray from the steps.

    Exploratory calls are left out. A successful call of the first step starts the comparison anew. After it, a
    call of a step still open closes it if it succeeds, and counts if it fails out of order; a call of no open
    step counts, as does any call before the start, and each step open in the end. Without a start the number
    of steps counts, and without steps nothing does.

    Calls are sorted by trace and seq (ties: name, failed ones first) over ranges and cut into chunks of at most `chunk`
    calls. What a chunk does to the steps is known without what came before: whether it starts anew, and how many
    successful calls of each step's name follow its last start (or its beginning). Summed in order of chunks these tell which
    steps are open where a chunk begins; then each chunk is followed by itself. So a trace of any length is spread over
    tasks, and only sums by chunk and step are put in order trace by trace.
    """
    names = F.transform("steps", lambda s: F.split_part(s, F.lit("("), F.lit(1)))
    flows = workflows.select("trace_id", names.alias("names"))
    ok = F.coalesce(F.col("status") == "success", F.lit(False)).alias("ok")
    own = calls.where(~F.col("name").isin(*EXPLORATORY)).select("trace_id", "seq", "name", ok)
    order = ["trace_id", "seq", "name", "ok"]
    at = F.floor(F.monotonically_increasing_id() / chunk).alias("chunk")
    cut = written(own.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at))
    told = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "ok"))), lambda c: F.struct(c["name"].alias("name"), c["ok"].alias("ok")))
    chunks = written(cut.groupBy("trace_id", "chunk").agg(told.alias("calls")).join(flows.where(F.size("names") > 0), "trace_id"))

    def is_start(call: Column) -> Column:
        return call["ok"] & F.coalesce(call["name"] == F.element_at("names", 1), F.lit(False))

    last = F.array_max(F.transform("calls", lambda c, i: F.when(is_start(c), i)))
    tail = F.slice("calls", F.coalesce(F.col("last") + 2, F.lit(1)), F.size("calls"))
    done = F.transform("names", lambda n: F.size(F.filter(tail, lambda c: c["ok"] & F.coalesce(c["name"] == n, F.lit(False)))))
    effects = chunks.select("trace_id", "chunk", last.alias("last"), "names", "calls").select("trace_id", "chunk", F.col("last").isNotNull().alias("starts"), done.alias("done"))
    in_order = Window.partitionBy("trace_id").orderBy("chunk")
    effects = effects.withColumn("start", F.sum(F.col("starts").cast("long")).over(in_order))
    each = effects.select("trace_id", "chunk", "start", F.posexplode("done").alias("step", "n"))
    since = F.sum("n").over(Window.partitionBy("trace_id", "start", "step").orderBy("chunk"))
    before = Window.partitionBy("trace_id", "step").orderBy("chunk")
    each = each.withColumn("since", since).select(
        "trace_id", "chunk", "step", F.coalesce(F.lag("start").over(before), F.lit(0)).alias("start"), F.coalesce(F.lag("since").over(before), F.lit(0)).alias("since")
    )
    entered = each.groupBy("trace_id", "chunk").agg(
        (F.max("start") > 0).alias("started"), F.transform(F.array_sort(F.collect_list(F.struct("step", "since"))), lambda x: x["since"]).alias("closed")
    )

    # Steps of one name are closed from the first on. The start closes the first step, and any further success of its name is a start.
    every = F.sequence(F.lit(1), F.size("names"))

    def is_open(i: Column) -> Column:
        name = F.element_at("names", i)
        earlier = F.size(F.filter(F.slice("names", F.lit(1), i - 1), lambda n: n == name))
        return earlier >= F.when(name == F.element_at("names", 1), 1).otherwise(F.element_at("closed", i))

    left = F.when(F.col("started"), F.filter(every, is_open)).otherwise(every)
    state = F.struct(F.col("started").alias("started"), left.alias("open"), F.lit(0).alias("errors"))

    def step(acc: Column, call: Column) -> Column:
        restart = is_start(call)
        fitting = F.filter(acc["open"], lambda i: F.element_at("names", i) == call["name"])
        in_turn = F.coalesce(F.try_element_at(fitting, F.lit(1)) == F.try_element_at(acc["open"], F.lit(1)), F.lit(False))
        wrong = ~acc["started"] | (F.size(fitting) == 0) | (~call["ok"] & ~in_turn)
        closes = acc["started"] & call["ok"] & (F.size(fitting) > 0)
        still = F.when(closes, F.array_remove(acc["open"], F.try_element_at(fitting, F.lit(1)))).otherwise(acc["open"])
        return F.struct(
            (acc["started"] | restart).alias("started"),
            F.when(restart, F.slice(every, 2, F.size("names"))).otherwise(still).alias("open"),
            (acc["errors"] + F.when(restart | ~wrong, 0).otherwise(1)).alias("errors"),
        )

    followed = chunks.join(entered, ["trace_id", "chunk"]).select("trace_id", "chunk", F.aggregate("calls", state, step).alias("k"))
    whole = followed.groupBy("trace_id").agg(
        F.sum("k.errors").cast("int").alias("errors"), F.max_by(F.struct(F.col("k.started").alias("started"), F.size("k.open").alias("open")), "chunk").alias("end")
    )
    drift = F.when(F.col("end.started"), F.col("errors") + F.col("end.open")).otherwise(F.size("names"))
    return flows.join(whole, "trace_id", "left").select("trace_id", F.when(F.coalesce(F.size("names"), F.lit(0)) <= 0, 0).otherwise(drift).alias("errors"))


def trace_roots(steps: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of steps for each trace, by start: the earliest without a parent, else the earliest."""
    by = Window.partitionBy("trace_id").orderBy(F.col("parent_run_id").isNotNull(), "start_time", "run_id")
    roots = steps.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").orderBy("start_time", "trace_id")
    return roots if limit is None else roots.limit(limit)


def tool_steps(steps: DataFrame) -> DataFrame:
    """(trace_id, tools): a trace's tool calls in order of start, as name, input, success and content.

    An input that is a JSON object of one key stands for its value. steps has status and content.
    """
    keys = F.json_object_keys("inputs")
    only = F.get(F.map_values(F.from_json("inputs", "map<string, string>")), F.lit(0))
    tool = F.struct(
        "start_time", "run_id", "name", F.when(F.size(keys) == 1, only).otherwise(F.col("inputs")).alias("input"),
        (F.coalesce("status", F.lit("success")) != "error").alias("success"), F.col("outputs").alias("content"),
    )
    tools = F.transform(
        F.array_sort(F.collect_list(tool)),
        lambda t: F.struct(t["name"].alias("name"), t["input"].alias("input"), t["success"].alias("success"), t["content"].alias("content")),
    )
    return steps.where("run_type = 'tool'").groupBy("trace_id").agg(tools.alias("tools"))


def feedback_pivot(feedback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(run_id, a column for each key): the last score, or value where there is no score."""
    value = F.coalesce("score", "value")
    return feedback.groupBy("run_id").pivot("key", list(keys)).agg(F.max_by(value, "seq"))


def final_query(messages: DataFrame) -> DataFrame:
    """(trace_id, query): what was generated for the query id executed last, else the last generated one.

    messages: (trace_id, seq, generated_query, query_id, executed_query_id), nulls where a message has none.
    """
    executed = messages.where("executed_query_id IS NOT NULL").groupBy("trace_id").agg(F.max_by("executed_query_id", "seq").alias("query_id"))
    generated = messages.where("generated_query IS NOT NULL")
    of_id = generated.groupBy("trace_id", "query_id").agg(F.max_by("generated_query", "seq").alias("own"))
    last = generated.groupBy("trace_id").agg(F.max_by("generated_query", "seq").alias("last"))
    return (
        messages.select("trace_id").distinct().join(last, "trace_id", "left")
        .join(executed.join(of_id, ["trace_id", "query_id"]).drop("query_id"), "trace_id", "left")
        .select("trace_id", F.coalesce("own", "last", F.lit("")).alias("query"))
    )


def question_text(inputs: Column) -> Column:
    """The question in a JSON input: its last message, or one of several plain keys; else "Unknown"."""
    messages = F.from_json(F.get_json_object(inputs, "$.messages"), "array<struct<content: string>>")
    # inputs.inputs: its query_input, or the object as text.
    return F.coalesce(
        F.try_element_at(messages, F.lit(-1))["content"],
        *(F.get_json_object(inputs, f"$.{k}") for k in ("input", "query_input", "question", "inputs.query_input", "inputs")),
        F.lit("Unknown"),
    )


def difficulty_name(column: str = "difficulty") -> Column:
    """Impossible counts as very hard."""
    return F.when(F.col(column) == "impossible", "very hard").otherwise(F.col(column))


def accuracy_by_difficulty(runs: DataFrame, config: str = "config") -> DataFrame:
    """(config, difficulty, accuracy): means by difficulty, and over all runs (difficulty "all")."""
    by = runs.groupBy(config, difficulty_name().alias("difficulty")).agg(F.avg("accuracy").alias("accuracy"))
    return by.unionByName(runs.groupBy(config).agg(F.avg("accuracy").alias("accuracy")).withColumn("difficulty", F.lit("all")))


def compare_configurations(runs: DataFrame, config: str = "config") -> DataFrame:
    """One row for each configuration of runs(config, question, accuracy, tokens, latency, n_tools, type_1,
    type_2, type_3).

    consistency is 1 - 2 * the mean over questions of the standard deviation of accuracy, within 0 and 1; tokens
    are for one pass, by the number of runs of the first question (Q14). Nulls count in no mean.
    """
    by_question = runs.groupBy(config, "question").agg(F.stddev_pop("accuracy").alias("sd"), F.count("*").alias("n"))
    steady = by_question.groupBy(config).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.avg("sd"))).alias("consistency"), F.min_by("n", "question").alias("passes")
    )
    means = runs.groupBy(config).agg(
        F.avg("accuracy").alias("accuracy"), F.sum("tokens").alias("tokens"), F.avg("latency").alias("latency"), F.avg("n_tools").alias("tool_calls"),
        *(F.avg(f"type_{i}").alias(f"type_{i}") for i in (1, 2, 3)),
    )
    out = means.join(steady, config)
    return out.select(config, "accuracy", "consistency", (F.col("tokens") / F.col("passes")).alias("tokens_per_pass"), "latency", "tool_calls", "type_1", "type_2", "type_3")


def latency_seconds(start: str = "start_time", end: str = "end_time") -> Column:
    """Seconds between two timestamps, with their fractions."""
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (end, start)]
    return (micros[0] - micros[1]) / 1e6


def _outside_pairs(body: Column) -> Column:
    """Signs that stand in no pair of matching parentheses, however deep; a parenthesis without its partner hides nothing.

    No ( before a lone ) stays open and no ) after a lone ( does, so a sign is outside if nothing is open before it,
    read forwards, or if it follows the first lone ( and nothing is open behind it, read backwards.
    """
    signs = F.regexp_extract_all(body, F.lit("([()./;,])"), 1)

    def fold(read: Column, opening: str, closing: str) -> Column:
        # free: signs at depth 0; beyond: those of them met before the last lone closing sign.
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("free"), F.lit(0).alias("beyond"))

        def step(acc: Column, sign: Column) -> Column:
            lone = (sign == closing) & (acc["depth"] == 0)
            depth = F.when(sign == opening, acc["depth"] + 1).when(sign == closing, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
            free = acc["free"] + F.when(~sign.isin(opening, closing) & (acc["depth"] == 0), 1).otherwise(0)
            return F.struct(depth.alias("depth"), free.alias("free"), F.when(lone, acc["free"]).otherwise(acc["beyond"]).alias("beyond"))

        return F.aggregate(read, start, step)

    both = fold(signs, "(", ")")["free"] + fold(F.reverse(signs), ")", "(")["beyond"]
    return F.when(body.contains("("), both).otherwise(F.regexp_count(body, F.lit(SIGNS)))


#: What the metric takes out of a query before it counts: comment lines, texts, URIs.
COMMENT, QUOTED, ANGLED = r"(?m)^#.*\n?", r'"[^"\\]*(?:\\[^\n][^"\\]*)*"', r"<[^>]*>"
#: The outer braces of a query, with what stands in them, and the signs that count.
BRACED, SIGNS = r"^[^{]*\{([\s\S]*)\}[^}]*$", "[./;,]"


def count_hops(query: Column) -> Column:
    """Signs that join triples (. ; ,) and path steps (/) in the outer braces of a query.

    Comment lines, texts, URIs and what stands in parentheses do not count.
    """
    bare = F.regexp_replace(query, COMMENT, "")
    body = F.when(bare.rlike(BRACED), F.regexp_extract(bare, BRACED, 1)).otherwise(bare)
    for gone in (QUOTED, ANGLED):
        body = F.regexp_replace(body, gone, " ")
    return _outside_pairs(body)


def query_difficulty(query: Column, given: Column) -> Column:
    """Impossible stays; easy and medium have few hops and neither groups, counts nor order; others are hard."""
    special = F.upper(query).rlike(r"\b(GROUP BY|COUNT|ORDER BY)\b")
    hops = count_hops(query)
    return (
        F.when(F.lower(given) == "impossible", "impossible")
        .when(~special & (hops <= EASY_HOPS), "easy")
        .when(~special & (hops <= MEDIUM_HOPS), "medium")
        .otherwise("hard")
    )


def split_counts(examples: DataFrame, split: str = "split") -> DataFrame:
    """(split, count)."""
    return examples.groupBy(split).count()


def select_examples(
    examples: DataFrame, origins: Sequence[str] = (), splits: Sequence[str] = (), offset: int = 0, by: Sequence[str] = ("file_path",)
) -> DataFrame:
    """Examples of the origins and splits (none named: all), from the offset on, in the order of `by`."""
    out = examples
    for column, wanted in (("origin", origins), ("split", splits)):
        out = out.where(F.col(column).isin(*wanted)) if wanted else out
    return out.orderBy(*by).offset(offset) if offset else out
