"""The registered queries of this subpackage, opN_<name>, and the SQL for them where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import conversations, decontam, exact, licenses, minhash, neighbours, packing, rollup, secrets, sharding, substrings, tokenalign, toxicity
from graphloom.llm.common import SPACE_CLASS, shared_dir

SHARD_BYTES = 32 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies, on two-word shingles at similarity 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (
  SELECT doc_id, len(w) AS k, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l
  FROM (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)),
s AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS g FROM places WHERE len(l) = 2 OR k = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b USING (g)
                    WHERE a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM reach AS r JOIN sym AS l ON l.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity, by a model of the labels that are not held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group of equal texts that stays."""
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
w AS (SELECT h, count(*) AS c, first(doc_id ORDER BY n DESC, doc_id) AS k FROM d GROUP BY h)
SELECT doc_id, k AS keep_id, c AS group_size, doc_id = k AS kept, h AS text_sha256 FROM d JOIN w USING (h)
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the license notices found in it, their spans and coverage."""
    return licenses.license_report(_table(spark, sf_dir, "documents"))


#: Signs that a revised count leaves out.
MARKS = "[#$%&*|]+"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after five batches, one of them sent twice.

    First every document is counted by words; then by letters and digits too. Then documents with marks are
    counted anew without them, and documents of fewer than 200 characters are deleted, and come back.
    """

    def words(text):
        return F.size(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""))

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    book = rollup.TokenRollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    book.commit("1-words", rollup.count_changes(docs, {"words-1": words(text)}))
    alnum = rollup.count_changes(docs, {"alnum-1": F.regexp_count(text, F.lit("[A-Za-z0-9]+"))})
    book.commit("2-alnum", alnum)
    book.commit("2-alnum", alnum)
    marked = docs.where(text.rlike(MARKS))
    book.commit("3-marks", rollup.count_changes(marked, {"words-1": words(F.regexp_replace(text, MARKS, " "))}))
    short = docs.where(F.char_length(text) < 200)
    book.commit("4-short", rollup.delete_changes(short, ["words-1", "alnum-1"]))
    counts = {"words-1": words(F.regexp_replace(text, MARKS, " ")), "alnum-1": F.regexp_count(text, F.lit("[A-Za-z0-9]+"))}
    book.commit("5-back", rollup.count_changes(short, counts))
    return book.totals()


OP5_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(len(list_filter(string_split_regex(
    regexp_replace(t, '[#$%&*|]+', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS tokens
FROM d GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'alnum-1', count(*), CAST(sum(len(regexp_extract_all(t, '[A-Za-z0-9]+'))) AS BIGINT)
FROM d GROUP BY 1, 2
"""


def token_rollup_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by two public tokenizers: all documents by one, then by the other too, then those with marks anew without them."""
    docs = _table(spark, sf_dir, "documents")
    first, second = {"word_bpe_49k": packing.token_counter("word_bpe_49k.json")}, {"byte_bpe_50k": packing.byte_token_counter("byte_bpe_50k.tiktoken")}
    book = rollup.TokenRollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    book.commit("1-word", rollup.tokenizer_changes(docs, first))
    book.commit("2-byte", rollup.tokenizer_changes(docs, second))
    marked = docs.where(F.col("text").rlike(MARKS)).withColumn("text", F.regexp_replace("text", MARKS, " "))
    book.commit("3-marks", rollup.tokenizer_changes(marked, first | second))
    return book.totals()


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), packing.public_tokenizer())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of at most SHARD_BYTES bytes of text."""
    return sharding.shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS b,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) AS h
  FROM documents),
n AS (
  SELECT g AS depth, h >> (60 - g) AS p, sum(b) AS bytes, count(*) AS docs
  FROM d, (SELECT unnest(range(0, 61)) AS g) GROUP BY 1, 2),
leaf AS (
  SELECT n.* FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.p = n.p >> 1
  WHERE (n.bytes <= {limit} OR n.docs = 1 OR n.depth = 60)
    AND (up.depth IS NULL OR NOT (up.bytes <= {limit} OR up.docs = 1)))
SELECT doc_id, right(lpad(bin(h), 60, '0'), 60)[1:depth] AS shard_id, CAST(depth AS INTEGER) AS depth,
       CAST(b AS BIGINT) AS text_bytes, CAST(bytes AS BIGINT) AS shard_bytes, CAST(docs AS BIGINT) AS shard_docs,
       bytes > {limit} AS oversized
FROM d JOIN leaf ON leaf.p = d.h >> (60 - leaf.depth)
"""


def shards_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of at most 64 KiB of text: deep directories at any size of input."""
    return sharding.shards(_table(spark, sf_dir, "documents"), 64 << 10)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the secrets found in it."""
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that repeat a window of 13 words of an earlier document."""
    return substrings.substring_duplicates(_table(spark, sf_dir, "documents")).drop("kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
windows AS (
  SELECT doc_id, i, array_to_string(l, ' ') AS g FROM (
    SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
    FROM words) WHERE len(l) = 13),
firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (g) WHERE doc_id > f)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark that it holds."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS g
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d)),
dw AS (
  SELECT doc_id, i, n, array_to_string(l[1:n], ' ') AS g
  FROM places, (SELECT DISTINCT n FROM bw) AS lengths WHERE len(l) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its ids, with its faults and the cheapest edits that repair it."""
    return conversations.repair_report(_table(spark, sf_dir, "conversations"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is divisible by 20 the 20 nearest of all others, by inner product."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors["vec_id"] % 20 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens by two tokenizers, their links, and how frequent those are in all documents."""
    return tokenalign.alignment(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_token_alignment": op13_token_alignment,
    "token_rollup_bpe": token_rollup_bpe,
    "shards_64k": shards_64k,
}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_token_counts": OP5_SQL,
    "op7_sharding": op7_sql(),
    "op9_substring_dedup": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "shards_64k": op7_sql(64 << 10),
}
