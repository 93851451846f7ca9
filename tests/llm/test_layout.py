"""Packing, sharding, token rollups and the registered queries."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_dedup import plain_components
from test_scans import plain_contamination

import corpus_pipeline
from graphloom.llm import packing, queries, rollup, sharding, toxicity

DATA = Path("/root/testdata/sf0.001")


def out(df, *names):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=key)


# Packing


def make_word_ids():
    """A tokenizer that is sent to workers by value, since they cannot import this module."""

    def word_ids():
        return lambda text: np.array([len(w) for w in text.split()], "<u4").tobytes()

    return word_ids


word_ids = make_word_ids()


def check_packing(rows, ids_by_doc, capacity):
    """Every id in one piece, sequences gapless and within capacity. Returns the padding's share."""
    pieces = Counter()
    by_sequence = {}
    for doc, start, length, crc, total, sequence, offset in rows:
        ids = ids_by_doc[doc]
        assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and length > 0
        pieces.update((doc, p) for p in range(start, start + length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert pieces == Counter({(d, p): 1 for d, ids in ids_by_doc.items() for p in range(len(ids))})
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(map(len, ids_by_doc.values()))
    return 1 - total / (len(by_sequence) * capacity) if by_sequence else 0


def test_packing_places_every_id(docs):
    rng = random.Random(1)
    pairs = [(i, " ".join(["x" * rng.randint(1, 9) for _ in range(rng.choice([0, 3, 7, 20, 70, 200]))])) for i in range(300)]
    pairs += [(900, None), (901, ""), (902, "ab " * 5000)]
    ids = {i: [*np.frombuffer(word_ids()(t or ""), "<u4"), 1] for i, t in pairs}
    for group_rows in (20_000, 5):
        rows = out(packing.pack(docs(*pairs), word_ids, capacity=64, group_rows=group_rows))
        assert check_packing(rows, ids, 64) < 0.02
    assert packing.pack(docs(), word_ids).count() == 0
    repeated = out(packing.pack(docs((None, "a"), (3, "a b"), (3, "a b")), word_ids))
    assert len(repeated) == 3 and len({(r[5], r[6]) for r in repeated}) == 3


@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9), max_size=12))
def test_plan_uses_each_piece_once(counts):
    plan = packing.fill_plan(counts, 40)
    used = Counter()
    for bins, taken in plan:
        assert bins > 0 and sum(n * c for n, c in taken.items()) <= 40
        used.update({n: bins * c for n, c in taken.items()})
    assert used == Counter({n: c for n, c in counts.items() if c})


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5))
def test_first_bin_has_least_slack(counts):
    first = max(counts)
    rest = [n for n, c in counts.items() for _ in range(c - (n == first))]
    sums = {0}
    for n in rest:
        sums |= {s + n for s in sums}
    best = max(s for s in sums if s <= 30 - first)
    assert sum(n * c for n, c in packing.fill_plan(counts, 30)[0][1].items()) == first + best


def test_tokenizer_equals_the_library():
    pytest.importorskip("public_tokenizers")
    words = packing.public_tokenizer()()
    rng = random.Random(0)
    signs = "aAéÉß'sşİıΣσςé.,- \x1c\x85\xa0ǅ漢1²½ñẞ\U0001f600‍\xad\tĲŉſµ<|&"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["Hello, world. It's <|endoftext|> I'M", "<|startoftext|>x", "a﻿b", "word " * 3000, "x" * 5000]
    for text in texts:
        assert np.frombuffer(words(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids, text


# Sharding


def test_shards_fit_and_match_sql(docs):
    rng = random.Random(3)
    pairs = [(i, "é" * rng.randint(0, 300)) for i in range(400)] + [(500, "x" * 9000), (501, None), (None, "null id"), (77, "again"), (77, "again")]
    d, db = docs(*pairs), duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", pairs)
    for limit in (500, 4000, 10**9):
        got = sharding.shards(d, limit)
        names = got.columns
        assert out(got) == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({queries.op7_sql(limit)})").fetchall(), key=lambda r: tuple((x is None, x) for x in r))
        assert out(got) == out(sharding.shards(d, limit, broadcast_leaves=0))
        for r in got.collect():
            assert r.shard_bytes <= limit or r.shard_docs == 1 or r.doc_id == 77
    assert sharding.shards(docs(), 10).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(d, 0)


def test_rows_of_one_id_stay_together(docs):
    got = out(sharding.shards(docs((1, "x" * 60), (1, "x" * 60)), 100), "depth", "shard_docs", "oversized")
    assert got == [(60, 2, True)] * 2


def test_written_shards(spark, docs, tmp_path):
    d = docs(*[(i, "x" * 50) for i in range(40)])
    sharding.write_shards(d, str(tmp_path / "s"), 400)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.groupBy("shard_id").agg(F.sum(F.length("text")).alias("n")).where("n > 400").count() == 0


def test_written_shards_keep_clashing_columns_and_repeats(spark, tmp_path):
    rows = [(i, "x" * 50, "mine", i, "e") for i in range(30)] + [(3, "x" * 50, "mine", 3, "e")] * 2 + [(None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard_id string, hash long, depth string")
    sharding.write_shards(d, str(tmp_path / "s"), 400)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "shard_id_", "hash", "depth").collect()) == Counter(rows)
    assert all(len(re.findall(r"part-", " ".join(f.name for f in folder.iterdir() if f.suffix == ".parquet"))) == 1 for folder in (tmp_path / "s").glob("shard_id=*"))
    sharding.write_shards(d.where("false"), str(tmp_path / "none"), 400)


# Rollups


def changes(spark, *rows):
    return spark.createDataFrame(rows, rollup.CHANGES)


def test_rollup_revises_deletes_and_counts_batches_once(spark, tmp_path):
    book = rollup.TokenRollup(spark, str(tmp_path / "book"))
    assert book.totals().count() == 0
    first = changes(spark, (0, "upsert", 1, "s", "en", "v1", 10), (0, "upsert", 2, "s", None, "v1", 5), (0, "upsert", 1, "s", "en", "v2", 7), (0, "upsert", None, "s", "en", "v1", 99))
    assert book.commit("a", first) and not book.commit("a", first)
    assert out(book.totals()) == [("s", "en", "v1", 1, 10), ("s", "en", "v2", 1, 7), ("s", None, "v1", 1, 5)]
    second = changes(
        spark, (1, "upsert", 1, "t", "en", "v1", 12), (1, "delete", 2, None, None, "v1", 0), (2, "upsert", 2, "s", "de", "v1", 6),
        (1, "delete", 9, None, None, "v1", 0), (1, "upsert", 1, "t", "en", "v1", 12), (1, "delete", 1, None, None, "v2", 0), (0, "upsert", 3, "s", "en", "v1", 0),
    )
    assert book.commit("b", second) and not book.commit("b", changes(spark))
    assert out(book.totals()) == [("s", "de", "v1", 1, 6), ("s", "en", "v1", 1, 0), ("t", "en", "v1", 1, 12)]
    assert out(book.state(), "doc_id", "tokens") == [(1, 12), (2, 6), (3, 0)]
    assert rollup.TokenRollup(spark, str(tmp_path / "book")).committed() == ["a", "b"]
    with pytest.raises(ValueError):
        book.commit("../x", second)


def test_broken_batch_is_written_anew(spark, tmp_path):
    book = rollup.TokenRollup(spark, str(tmp_path / "book"))
    book.commit("a", changes(spark, (0, "upsert", 1, "s", "en", "v1", 10)))
    (tmp_path / "book/deltas/batch=a/_SUCCESS").unlink()
    assert book.committed() == [] and book.totals().count() == 0
    book.commit("a", changes(spark, (0, "upsert", 1, "s", "en", "v1", 11)))
    assert out(book.totals(), "tokens") == [(11,)]


def test_a_batch_reads_the_files_of_its_documents(spark, tmp_path):
    book = rollup.TokenRollup(spark, str(tmp_path / "book"), file_rows=20_000)
    n = 1_000_000
    every = spark.range(n).selectExpr("0L AS batch_seq", "'upsert' AS op", "id AS doc_id", "'s' AS source", "'en' AS lang", "'v1' AS tokenizer", "id % 9 AS tokens")
    book.commit("a", every)
    files = book._files("ledger/batch=a")
    assert len(files) >= 40 and max(f.n for f in files) < 60_000  # writers grow with rows
    some = every.where("doc_id BETWEEN 500000 AND 500999").withColumn("tokens", F.lit(100).cast("long"))

    def size(df):
        return sum(Path(unquote(urlparse(f).path)).stat().st_size for f in df.inputFiles())

    assert 0 < size(book.ledger(some)) < 0.05 * size(book.ledger())
    read = []

    class Watched(rollup.TokenRollup):
        def ledger(self, changes=None):
            read.append(super().ledger(changes))
            return read[-1]

    Watched(spark, str(tmp_path / "book")).commit("b", some)
    assert len(read) == 1 and read[0].count() < 0.08 * n
    assert out(book.totals(), "docs", "tokens") == [(n, sum(i % 9 for i in range(n)) + sum(100 - i % 9 for i in range(500000, 501000)))]


@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 9), st.lists(st.integers(-2, 45), max_size=9))
def test_files_that_have_an_id(values, cuts, ids):
    values.sort()
    parts = [p for p in np.array_split(np.array(values), cuts) if len(p)]
    low, high = np.array([p[0] for p in parts]), np.array([p[-1] for p in parts])
    want = [i for i in range(len(parts)) if any(low[i] <= x <= high[i] for x in ids)]
    assert rollup.files_hit(low, high, np.array(ids, np.int64)).tolist() == want


def test_folded_ledgers_say_the_same(spark, tmp_path):
    books = [rollup.TokenRollup(spark, str(tmp_path / name), every) for name, every in (("often", 1), ("never", 99))]
    rng = random.Random(2)
    for batch in range(3):
        rows = [(i, rng.choice(["upsert", "delete"]), rng.randrange(30), "s", "en", "v1", rng.randrange(9)) for i in range(25)]
        for book in books:
            book.commit(f"b{batch}", changes(spark, *rows))
    assert out(books[0].state()) == out(books[1].state()) and out(books[0].totals()) == out(books[1].totals())
    assert books[0]._folded() == (2, {"b0", "b1", "b2"}) and len(out(books[0].ledger())) == len(out(books[0].state()))
    (tmp_path / "often/folded/2/_SUCCESS").unlink()  # a fold that broke off: the one before it counts
    assert books[0]._folded() == (1, {"b0", "b1"}) and out(books[0].state()) == out(books[1].state())


def test_counts_by_public_tokenizers(spark, docs):
    pytest.importorskip("public_tokenizers")
    texts = ["Hello, world. It's 12 o'clock", "É é\n漢字 <|endoftext|>", "", None, "x" * 3000]
    makers = {"word": packing.token_counter(), "byte": packing.byte_token_counter()}
    got = rollup.tokenizer_changes(docs(*enumerate(texts)), makers)
    import public_tokenizers
    import tokenizers

    for name, file in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")):
        plain = tokenizers.Tokenizer.from_file(public_tokenizers.path(file))
        plain.encode_special_tokens = name == "byte"
        want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
        assert out(got.where(F.col("tokenizer") == name), "doc_id", "tokens") == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_rollup_by_public_tokenizers(spark):
    pytest.importorskip("public_tokenizers")
    word, byte = packing.token_counter()(), packing.byte_token_counter()()
    want = {}
    for r in spark.read.parquet(str(DATA / "documents.parquet")).collect():
        text = re.sub(queries.MARKS, " ", r.text or "")
        for name, count in (("word_bpe_49k", word), ("byte_bpe_50k", byte)):
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs + 1, tokens + count(text)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.token_rollup_bpe(spark, str(DATA)).collect()}
    assert got == want


def test_any_order_of_histories_gives_the_same_state(spark, tmp_path):
    rng = random.Random(8)
    book, now = rollup.TokenRollup(spark, str(tmp_path / "book"), compact_every=2), {}
    for batch in range(4):
        rows = []
        for seq in range(25):
            doc, op, n = rng.randrange(8), rng.choice(["upsert", "upsert", "delete"]), rng.randrange(50)
            rows.append((seq, op, doc, "s", "l", "v", n))
            now.pop(doc, None) if op == "delete" else now.update({doc: n})
        rng.shuffle(rows)
        book.commit(f"b{batch}", changes(spark, *rows))
    assert out(book.state(), "doc_id", "tokens") == sorted(now.items())
    assert out(book.totals(), "docs", "tokens") == [(len(now), sum(now.values()))]


def test_count_changes(docs):
    got = rollup.count_changes(docs((1, "a b"), (2, None)), {"v": F.regexp_count("text", F.lit("[a-z]"))})
    assert out(got, "doc_id", "tokenizer", "tokens") == [(1, "v", 2), (2, "v", 0)]


# Queries and the pipeline


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA / table}.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert out(got, *names) == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall(), key=key)


def plain_toxic(model, text):
    """Whether the sum of weights and of products over pairs of the text's weighed terms reaches the threshold."""
    at = {b: i + 1 for i, b in enumerate(model.buckets.tolist())}
    words = set(re.findall(r"[^\W_]+", (text or "").lower()))
    places = sorted({0} | {at[b] for w in words for b in toxicity._buckets(w) if b in at})
    v = model.factors[places].astype(float)
    total = model.linear[places].sum(dtype=float) + sum(v[i] @ v[:i].sum(axis=0) for i in range(1, len(v)))
    return 1 / (1 + np.exp(-total)) >= toxicity.THRESHOLD


def plain_exact(rows):
    """Of rows (id, text, ...) those that stay."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_near(rows, k=2):
    """Of rows with ids of their own, those with the smallest id of their component."""
    kept = {i for i, _, component, is_kept in plain_components([r[:2] for r in rows if r[0] is not None], k, 80) if is_kept}
    return [r for r in rows if r[0] is None or r[0] in kept]


def plain_clean(rows, items):
    dirty = {r[0] for r in plain_contamination([r[:2] for r in rows if r[0] is not None], items) if r[5]}
    return [r for r in rows if r[0] not in dirty]


def run_stages(spark, sf_dir):
    """Rows before and after each stage but the last, and the last one's pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert after.schema.names == docs.schema.names
        kept[name] = (out(docs), out(after))
        docs = after
    return kept, [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()]


def hold_against_plain_versions(spark, sf_dir, kept, pieces):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id IS NOT NULL").collect()]
    model = toxicity.fit(docs, labels.where(~toxicity.is_held_out(labels["doc_id"])))

    def same(name, plain):
        before, after = kept[name]
        assert Counter(after) == Counter(plain(before)), name

    same("toxicity", lambda rows: [r for r in rows if not plain_toxic(model, r[1])])
    same("exact_dedup", plain_exact)
    same("near_dedup", plain_near)
    same("decontamination", lambda rows: plain_clean(rows, items))
    whole, left = packing.public_tokenizer()().whole, kept["decontamination"][1]
    tokens = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in left}
    return check_packing(pieces, tokens, packing.CAPACITY)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_pipeline_stages_match_plain_versions(spark):
    kept, pieces = run_stages(spark, str(DATA))
    assert hold_against_plain_versions(spark, str(DATA), kept, pieces) < 0.02
    assert len(kept["near_dedup"][1]) < len(kept["near_dedup"][0]) < len(kept["exact_dedup"][0]) < len(kept["toxicity"][0])


def test_pipeline_of_nulls_repeats_and_extra_columns(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    item = " ".join(f"q{i}" for i in range(25))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 50)) + ["zlarf"] * (i % 6 == 0))) for i in range(150)]
    near = rows[1][1].split()
    rows += [(200 + i, " ".join(near[:-1] + [f"t{i}"])) for i in range(4)] + [(220, f"{item} tail"), (221, " ".join([item, *(f"z{i}" for i in range(900))]))]
    rows += [(300, None), (301, ""), (302, " \t"), (1, rows[1][1]), (1, rows[1][1]), (2, f" {rows[2][1]}"), (None, rows[3][1]), (None, "alone"), (400, "x " * 20_000)]
    schema = "doc_id long, text string, id long, hash string, copies int, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, 1, "h", 2, None, "s", 0) for i, t in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("zlarf" in (t or "")), None) for i, t in rows[:150]] + [(None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "w1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, pieces = run_stages(spark, str(tmp_path))
    hold_against_plain_versions(spark, str(tmp_path), kept, pieces)
    left = [r[0] for r in kept["decontamination"][1]]
    assert len(left) == len(set(left)) and None in left and 220 not in left and 221 in left and not any(i and i < 150 and i % 6 == 0 for i in left)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
