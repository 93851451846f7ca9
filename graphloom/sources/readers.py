"""Tables of triples, schema edges, statistics, query corpora and run records: reading, writing and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms

TRIPLES = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
EDGES = "source_type string, edge string, target_type string"
EDGE_STATS, NODE_STATS = "edge string, count long", "node_type string, count long"
RUNS = (
    "run_id string, question string, difficulty string, output struct<generated_query: string, final_answer: string>, "
    "metrics struct<accuracy: double, `llm score`: double, `type 1 errors`: int, `type 2 errors`: int, `type 3 errors`: int, "
    "tokens: long, latency: double>, tools array<struct<name: string, input: string, success: boolean, content: string>>"
)


def read_triples(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """A Parquet table of triples, partitioned by predicate or not. typed: also o_num, o_first_day, o_last_day
    and o_seconds, null where the text is no such value."""
    triples = spark.read.schema(TRIPLES).parquet(path)
    return with_values(triples) if typed else triples


def with_values(triples: DataFrame) -> DataFrame:
    """Literals cast once to numbers, dates and durations."""
    literal = F.when(terms.is_literal(F.col("o_kind")), F.col("o"))
    return triples.withColumns(
        {
            "o_num": terms.number(literal),
            "o_first_day": terms.first_day(literal),
            "o_last_day": terms.last_day(literal),
            "o_seconds": terms.duration_seconds(literal),
        }
    )


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples as Parquet by predicate, so that a pattern reads its own predicate only."""
    triples.select(*(c.split()[0] for c in TRIPLES.split(", "))).write.partitionBy("p").parquet(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(subj, pred, obj): the first three fields of each CSV line; lines with fewer are left out, none is a header."""
    lines = spark.read.schema("subj string, pred string, obj string, _bad string").option("columnNameOfCorruptRecord", "_bad")
    rows = lines.option("header", False).option("mode", "PERMISSIVE").csv(path)
    return rows.where("subj IS NOT NULL AND pred IS NOT NULL AND obj IS NOT NULL").select("subj", "pred", "obj")


def read_statistics(spark: SparkSession, edges: str, edge_stats: str, node_stats: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schema edges, counts of predicates and counts of classes, from CSV files with headers."""
    return tuple(
        spark.read.schema(schema).option("header", True).csv(path)
        for schema, path in ((EDGES, edges), (EDGE_STATS, edge_stats), (NODE_STATS, node_stats))
    )


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header; append adds files to a folder that is there."""
    df.write.mode("append" if append else "error").option("header", True).csv(path)


def read_query_corpus(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row for each record that has a question and a query: (file_path, category, split, origin, question,
    query, workflow).

    Records are lines `# key: value`, then `# query:` and the query, then `# workflow` and a step on each line. A file is
    one record; with a separator it has many, each ended by that, since a file for each costs more than its record.
    """
    text = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    files = text.withColumn("file_path", F.col("_metadata.file_path"))

    def header(key: str) -> Column:
        return F.nullif(F.btrim(F.regexp_extract("value", rf"(?im)^\s*#\s*{key}\s*:[ \t]*(.*)$", 1), F.lit(' "\t\r')), F.lit(""))

    query = F.btrim(F.regexp_extract("value", r"(?im)(?:^\s*#\s*query\s*:?[^\n]*\n)((?:(?!^\s*#\s*workflow)[\s\S])*)", 1), F.lit(" \t\r\n"))
    steps = F.regexp_extract("value", r"(?im)^\s*#\s*workflow[^\n]*\n([\s\S]*)", 1)
    workflow = F.filter(F.transform(F.split(steps, r"\r?\n"), F.trim), lambda s: s != "")
    return files.select(
        "file_path",
        *(header(k).alias(k) for k in ("category", "split", "origin", "question")),
        F.nullif(query, F.lit("")).alias("query"),
        workflow.alias("workflow"),
    ).where("question IS NOT NULL AND query IS NOT NULL")


def read_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run records from JSON (an array over several lines, or a record a line)."""
    return spark.read.schema(RUNS).option("multiLine", multi_line).json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records as JSON, one a line."""
    runs.write.json(path)


def run_report(runs: DataFrame, *keys: str) -> DataFrame:
    """Value, after the key columns asked for: a text report of each run. Missing scores count as 0.

    Fixed values: the report's names and signs.
    """
    tool = F.transform(
        "tools",
        lambda t: F.concat(
            F.lit("- "), F.coalesce(t["name"], F.lit("unknown_tool")), F.lit("("), F.coalesce(t["input"], F.lit("")), F.lit(")"),
            F.when(t["success"] == F.lit(False), F.lit(" ERROR")).otherwise(F.lit("")),
        ),
    )
    scores = F.concat(
        F.lit("accuracy: "), F.coalesce(F.col("metrics.accuracy"), F.lit(0.0)).cast("string"),
        F.lit("   llm: "), F.coalesce(F.col("metrics.`llm score`"), F.lit(0.0)).cast("string"),
    )
    parts = F.concat(
        F.array(F.concat(F.lit("question: "), F.coalesce("question", F.lit("")))),
        F.coalesce(tool, F.array().cast("array<string>")),
        F.array(F.concat(F.lit("query:\n"), F.coalesce("output.generated_query", F.lit(""))), scores, F.lit("-" * 40)),
    )
    return runs.select(*keys, F.array_join(parts, "\n").alias("value"))


def write_report(runs: DataFrame, path: str) -> None:
    """run_report as text files."""
    run_report(runs).write.text(path)


def flat_bindings(rows: DataFrame, column: str) -> DataFrame:
    """A JSON object {variable: {type, value, ...}} as a map of variable to value; types and languages go."""
    bound = F.from_json(F.col(column), "map<string, struct<type: string, value: string>>")
    return rows.withColumn(column, F.transform_values(bound, lambda _, v: v["value"]))
