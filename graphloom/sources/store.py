"""Triples stored with numbers for terms, in buckets by subject and by object, so that stars join without a shuffle."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.numbering import SMALL, Scratch, numbered, numbered_as_written

#: Triples of a bucket aimed at, and of one subject or object from which on it is kept outside the buckets.
BUCKET_ROWS, HEAVY_ROWS = 2_000_000, 1_000_000
#: Terms at an end of one in so many of a batch's triples are broadcast: as many at each end at most, and none longer than this.
FREQUENT, SHORT = 50_000, 1_000
#: Bytes of terms that a task may hold to look triples up; with more they are joined by sorting. What a term takes besides its text.
HELD_BYTES, TERM_BYTES = 512 << 20, 100
#: Triples of a batch that get numbers in one job, as what a job shuffles lies on disk until it ends, and jobs at most.
SLICE_ROWS, MOST_SLICES = 1 << 28, 32
#: Bits of a sort key that a term's number has; the number of the predicate has the others.
_ID_BITS = 44
_TERM = "o_kind string, o_dt string, o_lang string"
#: Tables: columns, and the column of the buckets.
_TABLES = {
    "terms_by_text": ("text string, id long, batch long", "text"),
    "terms_by_id": ("text string, id long, batch long", "id"),
    "by_s": (f"s long, p string, o long, {_TERM}, batch long", "s"),
    "by_o": (f"s long, p string, o long, {_TERM}, batch long", "o"),
}
_PLAIN = {"heavy_s": _TABLES["by_s"][0], "heavy_o": _TABLES["by_o"][0], "heavy_keys_s": "s long, batch long", "heavy_keys_o": "o long, batch long"}


#: While a batch is written: what a job has shuffled goes when it ends; a task that has one bucket leaves its rows as they are
#: sorted, where they would be sorted again by bucket; and buckets are read as such wherever they were written.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "1",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _slice(column: str, slices: int) -> Column:
    """The slice of a text, by another hash than the one that deals rows to buckets."""
    return F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")


class _Side(NamedTuple):
    """What tells the terms of one end that are frequent, rare or heavy there, and counts for a batch."""

    often: Column
    rare: Column
    heavy: Column
    counts: dict[str, Column]


class _Batch(NamedTuple):
    """Triples to store, written once with the slice that has their subject (_slice), how many slices there are, the predicates (p, _p),
    unless they are very many, _p being p's number in their order, and the triples' count."""

    rows: DataFrame
    slices: int
    predicates: DataFrame | None
    total: int


class TripleStore:
    """A folder of tables: a dictionary of terms, and each triple twice, in buckets by subject and by object.

    Buckets are sorted by predicate, so that a pattern reads the pages of its own predicate, and patterns over one
    subject (or object) meet bucket by bucket, without a shuffle. A subject or object of HEAVY_ROWS triples or more would
    make one task's bucket too large: its triples lie in a plain table, and are joined as any rows. A term is heavy
    in all its triples or in none, so a join over buckets and one over the plain tables give all solutions.

    Triples with a null subject, predicate or object match nothing and are left out; repeated triples stay.
    `append` adds a batch: terms that are new get the next numbers. A batch counts once its commit is written, and what
    a broken one has left is not read. A term that grows heavy by later batches stays in its bucket.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Opens the store that lies at path."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = json.loads(spark.read.text(f"{self.path}/layout").first().value)["buckets"]
        self.name = f"store_{uuid.uuid4().hex}"
        for table, (columns, key) in _TABLES.items():
            self._named(table, f"{self.path}/{table}", columns, key)

    @classmethod
    def create(cls, triples: DataFrame, path: str, buckets: int | None = None) -> TripleStore:
        """Writes triples to an empty folder. buckets: for ever; by default one for each BUCKET_ROWS."""
        spark = triples.sparkSession
        with Scratch(spark) as small, Scratch(spark) as large, _set(spark, _SETTINGS):
            added = cls._surveyed(triples, small, large)
            if buckets is None:
                buckets = max(8, -(-added.total // BUCKET_ROWS))
            spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/layout")
            store = cls(spark, path)
            store._append(added, small, large)
        return store

    def _named(self, table: str, path: str, columns: str, key: str) -> None:
        """Makes a table of buckets by the key known by the store's name and its own."""
        options = ", ".join(f"'{k}' '{v}'" for k, v in {"path": path, **SMALL}.items())
        self.spark.sql(f"CREATE TABLE {self.name}_{table} ({columns}) USING parquet OPTIONS ({options}) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS")

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for table in (*_TABLES, "placed"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def _log(self, kind: str) -> list[int]:
        try:
            return [r.batch for r in self.spark.read.schema("batch long").json(f"{self.path}/{kind}").collect()]
        except Exception as error:  # nothing logged yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    def _note(self, kind: str, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").json(f"{self.path}/{kind}")

    def _read(self, table: str) -> DataFrame | None:
        """The committed rows of a table; None if it has no files."""
        begun, done = self._log("begun"), self._log("done")
        if not done:
            return None
        if table in _TABLES:
            found = self.spark.table(f"{self.name}_{table}")
        else:
            try:
                found = self.spark.read.schema(_PLAIN[table]).parquet(f"{self.path}/{table}")
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                return None
        broken = sorted(set(begun) - set(done))
        return found.where(~F.col("batch").isin(broken)) if broken else found

    def _bucketed(self, rows: DataFrame, table: str, predicates: DataFrame | None = None, dealt: bool = False) -> None:
        """Adds rows to a table of buckets, sorted by (p and) its key.

        predicates: (p, _p), _p being p's number in their order. dealt: the rows lie in the table's buckets already.
        """
        columns, key = _TABLES[table]
        names = [c.split()[0] for c in columns.split(", ")]
        order = [F.col(key)]
        if predicates is not None:  # one number sorts several times as fast as a text and a number
            rows = rows.join(F.broadcast(predicates), "p")
            order = [F.shiftleft("_p", _ID_BITS) + F.col(key)]
        elif "p" in names:
            order = [F.col("p"), F.col(key)]
        if not dealt:
            rows = rows.repartition(self.buckets, key)
        self._saved(rows.sortWithinPartitions(*order).select(*names), table, f"{self.path}/{table}", key)  # one file a bucket

    def _saved(self, rows: DataFrame, table: str, path: str, key: str) -> None:
        rows.write.mode("append").bucketBy(self.buckets, key).format("parquet").options(path=path, **SMALL).saveAsTable(f"{self.name}_{table}")

    @staticmethod
    def _surveyed(triples: DataFrame, small: Scratch, large: Scratch) -> _Batch:
        found = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        slices = max(1, min(MOST_SLICES, -(-found.count() // SLICE_ROWS)))
        with _set(triples.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(slices)}):
            rows = large.written(found.withColumn("_slice", _slice("s", slices)), "_slice")
        counts = small.written(rows.groupBy("p").count())
        total, many = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*") >= 1 << 16).first()
        predicates = None if many else small.written(numbered(counts.select("p"), ["p"], "_p", write=small.written))
        return _Batch(rows, slices, predicates, total)

    def append(self, triples: DataFrame) -> None:
        """Adds triples (s, p, o, o_kind, o_dt, o_lang) as one batch."""
        with Scratch(self.spark) as small, Scratch(self.spark) as large, _set(self.spark, _SETTINGS):
            self._append(self._surveyed(triples, small, large), small, large)

    def _append(self, added: _Batch, small: Scratch, large: Scratch) -> None:
        """small, large: scratch tables; those of the batch's triples and terms as texts are large, and go once the triples have numbers."""
        rows, slices, predicates, total = added
        batch = max(self._log("begun"), default=0) + 1
        self._note("begun", batch)
        number = F.lit(batch).cast("long").alias("batch")
        terms, last = self._numbered_terms(rows, large)
        new = terms.where(F.col("id") > last).select("text", "id", number)
        self._bucketed(new, "terms_by_text", dealt=True)
        self._bucketed(new, "terms_by_id")
        ends = {end: self._sided(terms, end, last, total) for end in ("o", "s")}
        told = terms.agg(*(c.alias(f"{end}_{name}") for end, side in ends.items() for name, c in side.counts.items())).first()
        heavy = {}
        for key in ("s", "o"):
            before = self._read(f"heavy_keys_{key}")
            new = terms.where(ends[key].heavy).select(F.col("id").alias(key), number)
            if told[f"{key}_heavy"]:
                new.write.mode("append").parquet(f"{self.path}/heavy_keys_{key}")
            elif before is None:
                continue
            heavy[key] = F.broadcast(small.written((new if before is None else new.unionAll(before.select(key, number))).select(key)))
        few = {end: F.broadcast(small.written(terms.where(side.often).select("text", "id"))) for end, side in ends.items() if told[f"{end}_often"]}
        for i in range(slices):
            some = rows.where(F.col("_slice") == i)
            for end, side in ends.items():
                rare = terms.where(side.rare)
                if end == "s" and slices > 1:
                    rare = rare.where(_slice("text", slices) == i)
                held = (told[f"{end}_bytes"] or 0) <= HELD_BYTES * self.buckets
                some = self._looked_up(some, end, few.get(end), rare.select("text", "id"), held)
            some = some.select("s", "p", "o", "o_kind", "o_dt", "o_lang", number)
            if "s" not in heavy:
                self._bucketed(some, "by_s", predicates)
                continue
            with Scratch(self.spark) as once:
                self._bucketed(self._apart(once.written(some), "s", heavy["s"]), "by_s", predicates)
        large.remove()
        self.spark.sql(f"DROP TABLE {self.name}_placed")
        # The other copy is made of this one.
        self.spark.catalog.refreshTable(f"{self.name}_by_s")
        coded = self.spark.table(f"{self.name}_by_s").where(F.col("batch") == batch)
        if "s" in heavy:
            coded = coded.unionAll(self.spark.read.schema(_PLAIN["heavy_s"]).parquet(f"{self.path}/heavy_s").where(F.col("batch") == batch))
        if "o" in heavy:
            coded = self._apart(coded, "o", heavy["o"])
        parts = -(-slices // 3)  # of the buckets; this copy shuffles a third of what numbers take, or less
        for i in range(parts):
            self._bucketed(coded.where(F.pmod(F.hash("o"), F.lit(self.buckets)) % parts == i) if parts > 1 else coded, "by_o", predicates)
        self._note("done", batch)
        for table in _TABLES:
            self.spark.catalog.refreshTable(f"{self.name}_{table}")

    def _apart(self, coded: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
        """Adds the triples of heavy keys to their plain table, and gives the others."""
        some = coded.join(heavy, key, "left_semi").select(*coded.columns).sortWithinPartitions("p")
        some.write.mode("append").options(**SMALL).parquet(f"{self.path}/heavy_{key}")
        return coded.join(heavy, key, "left_anti").select(*coded.columns)

    def _numbered_terms(self, rows: DataFrame, large: Scratch) -> tuple[DataFrame, int]:
        """Terms of the rows (text, id, n_s and n_o: rows with it at either end, bytes) in buckets by text, and the last number known before."""
        ends = [rows.select(F.col(end).alias("text"), *(F.lit(int(e == end)).alias(f"n_{e}") for e in ("s", "o"))) for end in ("s", "o")]
        terms = reduce(DataFrame.unionAll, ends).groupBy("text").agg(*(F.sum(n).alias(n) for n in ("n_s", "n_o"))).repartition(self.buckets, "text")
        known = self._read("terms_by_text")
        last = 0
        if known is None:
            terms = terms.withColumn("id", F.lit(None).cast("long"))
        else:
            last, size = known.agg(F.max("id"), F.sum(F.octet_length("text") + TERM_BYTES)).first()
            last = last or 0
            known = known.select("text", "id")
            if (size or 0) <= HELD_BYTES * self.buckets:
                known = known.hint("shuffle_hash")
            terms = terms.join(known, "text", "left").sortWithinPartitions(F.col("id").isNotNull())

        def placed(df: DataFrame) -> DataFrame:
            path = f"{large.path}/placed"
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_placed")  # of a batch that broke off
            self._named("placed", path, "text string, id long, n_s long, n_o long, bytes int, _at long", "text")
            self._saved(df, "placed", path, "text")
            return self.spark.table(f"{self.name}_placed")

        # Counted and dealt by text in one shuffle. The written rows are packed: a usual split has more terms than a task can hold.
        with _set(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.files.maxPartitionBytes": "16m"}):
            terms = terms.select("text", "id", "n_s", "n_o", F.octet_length("text").alias("bytes"))
            return numbered_as_written(terms, "id", last + 1, placed), last

    @staticmethod
    def _sided(terms: DataFrame, end: str, last: int, total: int) -> _Side:
        n = F.col(f"n_{end}")
        often = (n * FREQUENT >= total) & (n > 1) & (F.col("bytes") <= SHORT)
        rare = (n > 0) & ~often
        # A term known before stays where its triples are.
        heavy = (F.col("id") > last) & (n >= HEAVY_ROWS)
        return _Side(often, rare, heavy, {"often": F.count_if(often), "bytes": F.sum(F.when(rare, F.col("bytes") + TERM_BYTES)), "heavy": F.count_if(heavy)})

    def _looked_up(self, rows: DataFrame, end: str, few: DataFrame | None, rare: DataFrame, held: bool) -> DataFrame:
        """rows with numbers for the texts in the column end, by frequent and rare terms (text, id); held: a task can hold its rare terms.

        Rows are dealt as the terms lie. Frequent terms are broadcast, so that their rows are not shuffled, and none of them is a
        task's whole work.
        """

        def join(some: DataFrame, ids: DataFrame) -> DataFrame:
            return some.join(ids.select(F.col("text").alias(end), F.col("id").alias("_id")), end).drop(end).withColumnRenamed("_id", end)

        if held:
            rare = rare.hint("shuffle_hash")
        if few is None:
            return join(rows.repartition(self.buckets, end), rare)
        rest = rows.join(few.select(F.col("text").alias(end)), end, "left_anti")
        return join(rows, few).unionByName(join(rest.repartition(self.buckets, end), rare))

    def predicate_counts(self) -> DataFrame:
        """(p, triples, subjects, objects) of each predicate: each copy is counted bucket by bucket, without a shuffle of triples."""

        def counted(key: str, *counts: Column) -> DataFrame:
            # A term's triples all lie in its bucket, or all in the plain table.
            found = [t.groupBy("p", key).agg(F.count("*").alias("n")) for t in self._branches(key)]
            return reduce(DataFrame.unionAll, found).groupBy("p").agg(*counts)

        subjects = counted("s", F.sum("n").alias("triples"), F.count("*").alias("subjects"))
        return subjects.join(counted("o", F.count("*").alias("objects")), "p").select("p", "triples", "subjects", "objects")

    def terms(self) -> DataFrame:
        """(id, text) of every term."""
        return self._read("terms_by_id").select("id", "text")

    def ids(self, texts: Iterable[str]) -> dict[str, int]:
        """The numbers of a few texts; only the buckets of a single one are read."""
        wanted = list(dict.fromkeys(texts))
        found = self._read("terms_by_text")
        return {r.text: r.id for r in found.where(F.col("text").isin(wanted)).collect()} if wanted and found is not None else {}

    def texts(self, solutions: DataFrame, *columns: str) -> DataFrame:
        """solutions with texts for the numbers in the columns; nulls stay."""
        for c in columns:
            terms = self.terms().withColumnsRenamed({"id": c, "text": "_text"})
            solutions = solutions.join(terms, c, "left").withColumn(c, F.col("_text")).drop("_text").select(*solutions.columns)
        return solutions

    def _branches(self, key: str) -> list[DataFrame]:
        """The triples in buckets by the key, and those of heavy keys if there are any."""
        return [t for t in (self._read(f"by_{key}"), self._read(f"heavy_{key}")) if t is not None]

    def triples(self) -> DataFrame:
        """(s, p, o, o_kind, o_dt, o_lang) of all triples, as texts."""
        found = reduce(DataFrame.unionAll, self._branches("s")).drop("batch")
        return self.texts(found, "s", "o")

    def _pattern(self, triples: DataFrame, key: str, p: str | Sequence[str], other: str, as_: str, ids: dict[str, int]) -> DataFrame:
        """One pattern around the key: (as_, variable of the other end)."""
        p = [p] if isinstance(p, str) else list(p)
        found = triples.where(F.col("p") == p[0] if len(p) == 1 else F.col("p").isin(p))
        end = "o" if key == "s" else "s"
        columns = [F.col(key).alias(as_)]
        if other.startswith("?"):
            if other[1:] == as_:
                return found.where(F.col(end) == F.col(key)).select(*columns)
            return found.select(*columns, F.col(end).alias(other[1:]))
        return found.where(F.col(end) == ids.get(other, -1)).select(*columns)

    def star(self, centre: str, *patterns: tuple[str | Sequence[str], str], key: str = "s") -> DataFrame:
        """Solutions, as numbers, of patterns that share their subject (key "s") or object (key "o").

        patterns: (predicate or alternatives, other end), a variable or the text of a term. Patterns join on all
        variables they share, the centre among them, which is what the buckets are by: no row is shuffled but those of heavy keys.
        """
        as_ = centre.removeprefix("?")
        ids = self.ids(o for _, o in patterns if not o.startswith("?"))

        def join(left: DataFrame, right: DataFrame) -> DataFrame:
            return left.join(right, [c for c in right.columns if c in left.columns])

        found = [reduce(join, [self._pattern(t, key, p, o, as_, ids) for p, o in patterns]) for t in self._branches(key)]
        return reduce(DataFrame.unionAll, found)

    def match(self, s: str, p: str, o: str) -> DataFrame:
        """Solutions, as numbers, of one pattern. A constant end picks the copy whose buckets have it, and is looked for there only."""
        key = "o" if s.startswith("?") and not o.startswith("?") else "s"
        own, other = (s, o) if key == "s" else (o, s)
        if own.startswith("?"):
            return self.star(own, (p, other), key=key)
        at = self.ids([own]).get(own, -1)
        ids = self.ids([other]) if not other.startswith("?") else {}
        found = [self._pattern(t.where(F.col(key) == at), key, p, other, "_own", ids).drop("_own") for t in self._branches(key)]
        return reduce(DataFrame.unionAll, found)

