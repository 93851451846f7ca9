"""Token counts as rollups that signed deltas keep up to date, in batches that count once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import text_column, written

KEYS = ("source", "lang", "tokenizer")
#: Signed rows of a file of the ledger, on average.
FILE_ROWS = 1_000_000
#: Batches after which the ledger is folded into one state.
COMPACT_EVERY = 16
CHANGES = "batch_seq long, op string, doc_id long, source string, lang string, tokenizer string, tokens long"
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def count_changes(
    docs: DataFrame, counters: Mapping[str, Column], op: str = "upsert", seq: int = 0, id_col: str = "doc_id"
) -> DataFrame:
    """Changes that set every document's count by each tokenizer version. counters: expressions over docs.

    docs has source and lang; nulls there are groups of their own. A null count is 0.
    """
    counts = F.array(
        *(F.struct(F.lit(name).alias("tokenizer"), F.coalesce(c, F.lit(0)).cast("long").alias("tokens")) for name, c in counters.items())
    )
    return docs.select(
        F.lit(seq).cast("long").alias("batch_seq"),
        F.lit(op).alias("op"),
        docs[id_col].cast("long").alias("doc_id"),
        docs["source"],
        docs["lang"],
        F.inline(counts),
    )


def tokenizer_changes(
    docs: DataFrame, tokenizers: Mapping[str, Callable[[], Callable[[str], int]]], op: str = "upsert", seq: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """As count_changes, with counts that Python functions make of the whole text, null as empty.

    tokenizers: by version, what makes, in the worker, the function from a text to its number of tokens.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {name: make() for name, make in tokenizers.items()}
        for batch in batches:
            texts = batch["text"].to_pylist()
            for name, of in count.items():
                n = len(texts)
                yield pa.RecordBatch.from_pydict({
                    "batch_seq": pa.array([seq] * n, pa.int64()), "op": pa.array([op] * n, pa.string()), "doc_id": batch["doc_id"],
                    "source": batch["source"], "lang": batch["lang"], "tokenizer": pa.array([name] * n, pa.string()),
                    "tokens": pa.array(map(of, texts), pa.int64()),
                })

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs["source"].cast("string"), docs["lang"].cast("string"), text_column(docs, text_col).alias("text")
    )
    return rows.mapInArrow(counted, CHANGES)


def delete_changes(docs: DataFrame, tokenizers: list[str], seq: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Changes that take the documents out of the totals."""
    return count_changes(docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}), {t: F.lit(0) for t in tokenizers}, "delete", seq, id_col)


def signed_deltas(changes: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, sign): what the changes take from the totals, and add to them.

    before: (doc_id, tokenizer, source, lang, tokens), at most one row for a document and version. Of several
    changes to one of these the highest batch_seq counts; among equals deletes give way, then the largest
    values win. An upsert of what is there revises it, a delete of what is not there does nothing, and
    unchanged counts give no rows. Null ids and versions are left out: they can't be told apart later.
    """
    value = F.struct("source", "lang", "tokens")
    last = (
        changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL")
        .groupBy("doc_id", "tokenizer")
        .agg(F.max(F.struct("batch_seq", F.col("op") != "delete", value.alias("new"))).alias("last"))
        .select("doc_id", "tokenizer", F.when(F.col("last.col2"), F.col("last.new")).alias("new"))
    )
    old = before.select("doc_id", "tokenizer", value.alias("old"))
    changed = last.join(old, ["doc_id", "tokenizer"], "left").where(~F.col("new").eqNullSafe(F.col("old")))
    signed = F.array(
        F.struct(F.col("old").alias("value"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("value"), F.lit(1).alias("sign"))
    )
    return (
        changed.select("doc_id", "tokenizer", F.inline(signed))
        .where("value IS NOT NULL")
        .select("doc_id", "value.source", "value.lang", "tokenizer", "value.tokens", "sign")
    )


def additive_totals(deltas: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens): sums of signed rows. They add up in any order and grouping."""
    return deltas.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens")
    )


_LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int"
_FILES = "file string, low long, high long, n long"


def files_hit(low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ranges low..high, in order and at most touching, have one of the ids."""
    first, end = np.searchsorted(high, ids), np.searchsorted(low, ids, "right")
    change = np.zeros(len(low) + 1, np.int64)
    held = end > first
    np.add.at(change, first[held], 1)
    np.add.at(change, end[held], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


class TokenRollup:
    """Totals under a folder in a store that driver and executors share.

    Each batch writes its signed rows to ledger/batch=<id>, sorted by document over files of about FILE_ROWS rows, with a
    list of the documents' range in each file, and then its sums to deltas/batch=<id>, whose _SUCCESS file is the
    commit. A batch that is committed already is not applied again; one that broke off is not read, and is written
    anew when it is sent again. One writer at a time.

    To find what its documents counted before, a batch reads the files whose range has one of them, of the last state and
    of later ledgers. Documents that come together with ids close to each other cost a few files; ids from everywhere
    cost all of them. After `compact_every` batches these are folded into a new state, state/<k>; the batches that
    it has are named in folded/<k>, whose _SUCCESS file makes it count.

    Null ids and versions are left out of every batch; null sources and languages are groups; repeated rows and ties are
    settled as in signed_deltas; an empty batch commits and changes nothing; further columns of changes are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.compact_every, self.file_rows = spark, path.rstrip("/"), compact_every, file_rows

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _complete(self, part: str) -> list[str]:
        """Names of the folders under a part that have been written in full."""
        fs, folder = self._fs(f"{self.path}/{part}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.path}/{part}/{n}/_SUCCESS")[1]))

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        return [n.removeprefix("batch=") for n in self._complete("deltas")]

    def _folded(self) -> tuple[int | None, set[str]]:
        """The newest state's number, and the batches in it: a name for each, as listed in its folder."""
        states = max(map(int, self._complete("folded")), default=None)
        if states is None:
            return None, set()
        return states, {r.value for r in self.spark.read.text(f"{self.path}/folded/{states}").collect()}

    def _parts(self) -> list[str]:
        """Folders of the state folded last and of the batches after it."""
        state, folded = self._folded()
        return ([] if state is None else [f"state/{state}"]) + [f"ledger/batch={b}" for b in self.committed() if b not in folded]

    def ledger(self, changes: DataFrame | None = None) -> DataFrame:
        """Signed rows of all batches, of the state folded last and the batches after it. changes: files with their documents only."""
        out = self.spark.createDataFrame([], _LEDGER)
        for part in self._parts():
            files = self._files(part)
            if changes is not None and files:
                files = self._hit(files, changes)
            if files:
                out = out.unionByName(self.spark.read.schema(_LEDGER).parquet(*(f"{self.path}/{part}/{f.file}" for f in files)))
        return out

    def _files(self, part: str) -> list:
        """The list of a folder's files, in order: a row for each FILE_ROWS rows."""
        return sorted(self.spark.read.schema(_FILES).parquet(f"{self.path}/{part}-files").collect(), key=lambda f: (f.low, f.high))

    def _hit(self, files: list, changes: DataFrame) -> list:
        """Those of a folder's files whose range has a document of the changes. Tasks look the ids up, and tell files."""
        low, high = (np.array([getattr(f, end) for f in files], np.int64) for end in ("low", "high"))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(files_hit(low, high, batch["doc_id"].to_numpy(zero_copy_only=False)))], ["file"])

        found = changes.where("doc_id IS NOT NULL").select("doc_id").mapInArrow(look, "file long").distinct().collect()
        return [files[r.file] for r in sorted(found)]

    def state(self, changes: DataFrame | None = None) -> DataFrame:
        """(doc_id, tokenizer, source, lang, tokens) of every document now (changes: of theirs): signed rows that do not cancel."""
        keys = ["doc_id", "tokenizer", "source", "lang", "tokens"]
        return self.ledger(changes).groupBy(*keys).agg(F.sum("sign").alias("n")).where("n > 0").select(*keys)

    def _write(self, rows: DataFrame, part: str) -> DataFrame:
        path, order = f"{self.path}/{part}", ["doc_id", "tokenizer"]
        rows = written(rows)
        many = max(1, -(-rows.count() // self.file_rows))
        columns = [c.split()[0] for c in _LEDGER.split(", ")]
        rows.select(*columns).repartitionByRange(many, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(_LEDGER).parquet(path)
        listed = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}-files")
        return back

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it is committed already. batch_id: letters, digits, - and _."""
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        # Written once: its documents are looked at before its rows are used.
        sent, ledger = f"{self.path}/sent/batch={batch_id}", f"ledger/batch={batch_id}"
        changes.write.mode("overwrite").parquet(sent)
        changes = self.spark.read.schema(CHANGES).parquet(sent)
        signed = self._write(signed_deltas(changes, self.state(changes)), ledger)
        additive_totals(signed).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        if len(self.committed()) - len(self._folded()[1]) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Folds all batches into one state. What broke off is not read, and is written over later."""
        state, batches = self._folded()[0], self.committed()
        number = 0 if state is None else state + 1
        self._write(self.state().withColumn("sign", F.lit(1)), f"state/{number}")
        names = self.spark.createDataFrame([(b,) for b in batches], "value string")
        names.coalesce(1).write.mode("overwrite").text(f"{self.path}/folded/{number}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) now, from the batches' sums alone. Empty groups are left out."""
        paths = [f"{self.path}/deltas/batch={b}" for b in self.committed()]
        deltas = self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], _TOTALS)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 OR tokens != 0")
