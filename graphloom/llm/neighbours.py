"""Nearest neighbours by largest inner product: multiprobe hashing with p-stable (Gaussian) projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Width of a slot, in standard deviations of a projection, and rows of a bucket aimed at.
WIDTH, BUCKET_ROWS = 1.35, 128
#: Most buckets that a query visits in a table: hashes are fitted so that the wanted recall is met within them.
VISITS = 2048
#: Queries whose exact neighbours the index is fitted on.
FIT_QUERIES = 64
#: Rows and queries of one block of a cell.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Most cells above these sizes that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Slots are numbered from here, so that a bucket's number has five bits for each.
_MIDDLE = 16


@dataclass
class Hashes:
    """Tables of hashes h(v) = floor((a . v + b) / width), on vectors brought to the unit sphere of one dimension more.

    There, with a coordinate that makes all lengths the longest one's, near means a large inner product. similarity:
    the cosine, there, of a query and its k-th neighbour; mass: the estimated chance at which a query stops visiting.
    """

    a: np.ndarray
    b: np.ndarray
    longest: float
    similarity: float = 0.0
    mass: float = 1.0

    @classmethod
    def drawn(cls, dimension: int, tables: int, hashes: int, longest: float, seed: int) -> Hashes:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, hashes, dimension + 1)), rng.random((tables, hashes)) * WIDTH, longest)

    def _projections(self, points: np.ndarray) -> np.ndarray:
        """(table, point, hash)."""
        return np.einsum("thd,nd->tnh", self.a, points, optimize=True)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows to be found."""
        x = x / self.longest
        return self._projections(np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True))))))

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries, whose own length does not matter."""
        return self._projections(np.hstack((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1)))))

    def slots(self, projections: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((projections + self.b[:, None]) / WIDTH).astype(np.int64) + _MIDDLE, 0, 2 * _MIDDLE - 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(table, row): the bucket of each row."""
        slots = self.slots(self.rows(x))
        return (slots << 5 * np.arange(slots.shape[2])).sum(2)

    def visits(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table: (buckets, chances) by query, likeliest first.

        A neighbour's projection lies around that of the query, shrunk by their cosine; the chance of a bucket is the
        product of those of its slots. The likeliest VISITS products come out whole when hash is joined after hash.
        """
        spread = math.sqrt(max(1e-6, 1 - self.similarity**2))
        count = math.ceil(7 * spread / WIDTH) + 1
        for table, of_query in enumerate(self.queries(q)):
            buckets, chances = np.zeros((len(q), 1), np.int64), np.ones((len(q), 1))
            for h in range(of_query.shape[1]):
                centre, b = self.similarity * of_query[:, h], self.b[table, h]
                first = np.floor((centre - 3.5 * spread + b) / WIDTH).astype(np.int64)
                slot = first[:, None] + np.arange(count)
                edges = _below((((first[:, None] + np.arange(count + 1)) * WIDTH - b) - centre[:, None]) / spread)
                slot = np.clip(slot + _MIDDLE, 0, 2 * _MIDDLE - 1)
                buckets = (buckets[:, :, None] + (slot << 5 * h)[:, None, :]).reshape(len(q), -1)
                chances = (chances[:, :, None] * np.diff(edges)[:, None, :]).reshape(len(q), -1)
                if chances.shape[1] > VISITS:
                    best = np.argpartition(-chances, VISITS - 1, axis=1)[:, :VISITS]
                    buckets, chances = np.take_along_axis(buckets, best, 1), np.take_along_axis(chances, best, 1)
            order = np.argsort(-chances, axis=1, kind="stable")
            yield np.take_along_axis(buckets, order, 1), np.take_along_axis(chances, order, 1)

    def visited(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table: (buckets by query, how many of them, from the first, are visited)."""
        for buckets, chances in self.visits(q):
            yield buckets, np.minimum((np.cumsum(chances, axis=1) < self.mass).sum(1) + 1, buckets.shape[1])


def _below(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, to 1e-7 (Abramowitz and Stegun, 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    return np.where(x > 0, 1 - tail, tail)


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added from the first coordinate to the last, the same wherever a pair is met."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k best of each row of scores (-inf: no candidate), ties to smaller ids.

    scores are near; what may be among the k best by them is multiplied anew.
    """
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        slack = 1e-9 * np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(x, axis=1).max()
        some, at = np.nonzero((scores >= edge - slack) & (scores > -np.inf))
    else:
        some, at = np.nonzero(scores > -np.inf)
    exact = _products(q[some], x[at])
    order = np.lexsort((ids[at], -exact, some))
    some, at, exact = some[order], at[order], exact[order]
    rank = np.arange(len(some)) - np.searchsorted(some, some)
    return some[rank < k], at[rank < k], exact[rank < k]


def _in_block(k: int, dimension: int):
    """One block of a cell: its queries meet its rows in the buckets that they visit."""

    def search(block: pa.Table) -> pa.Table:
        is_query = block["is_query"].to_numpy()
        queries, rows = block.filter(pa.array(is_query)), block.filter(pa.array(~is_query))
        out = {"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not len(queries) or not len(rows):
            return pa.table(out)
        lists = rows["buckets"].combine_chunks().flatten().to_numpy()
        order = np.argsort(lists, kind="stable")
        names, starts = np.unique(lists[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        x = _matrix(rows["v"], dimension)[order]
        # A null id would not be a number; it sorts first, as null does.
        ids = rows["id"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()[order]
        q, query = _matrix(queries["v"], dimension), queries["id"].to_numpy()
        visits = queries["buckets"].combine_chunks()
        sizes, wanted = np.diff(visits.offsets.to_numpy()), visits.flatten().to_numpy()
        of_query = np.repeat(np.arange(len(q)), sizes)
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        met = names[place] == wanted
        visit = np.zeros((len(q), len(names)), bool)
        visit[of_query[met], place[met]] = True
        found = []
        step = max(1, 2_000_000 // len(x))
        for low in range(0, len(q), step):
            part, some = q[low : low + step], visit[low : low + step]
            scores = np.full((len(part), len(x)), -np.inf)
            for b in np.flatnonzero(some.any(0)):
                who = np.flatnonzero(some[:, b])
                scores[who, starts[b] : ends[b]] = part[who] @ x[starts[b] : ends[b]].T
            who, at, exact = _best(scores, part, x, ids, k)
            found.append((query[low + who], ids[at], exact))
        parts = [np.concatenate(p) for p in zip(*found, strict=True)]
        at = pa.array(parts[1], mask=parts[1] == np.iinfo(np.int64).min)
        return pa.table({"query": pa.array(parts[0]), "id": at, "score": pa.array(parts[2])})

    return search


_FOUND = "query long, id long, score double"


def _exact(points: DataFrame, queries: np.ndarray, k: int, dimension: int) -> DataFrame:
    """(query, v, score): the k best rows for each of a few queries, by a scan of all points."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"], dimension)
            ids = batch["id"].fill_null(np.iinfo(np.int64).min).to_numpy()
            who, at, score = _best(queries @ x.T, queries, x, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(who), batch["v"].take(pa.array(at)), pa.array(score)], ["query", "v", "score"])

    kind = points.schema["v"].dataType.simpleString()
    found = points.select("id", "v").mapInArrow(scan, f"query long, v {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def fit(points: DataFrame, queries: DataFrame, dimension: int, k: int, tables: int, recall: float, seed: int) -> Hashes:
    """Hashes for points, fitted on the exact neighbours of FIT_QUERIES of the queries.

    As many hashes as make buckets of BUCKET_ROWS, or fewer, until the fit queries find `recall` of their neighbours
    within VISITS buckets a table; then the least mass that does. The driver holds FIT_QUERIES * (k + 1) vectors.
    """
    size, longest = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2))).first()
    some = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).select("v").collect()
    if not some:
        return Hashes.drawn(dimension, tables, 1, 1.0, seed)
    q = np.array([r.v for r in some], np.float64)
    # The query itself is among its k + 1 nearest, as a rule.
    near = _exact(points, q, k + 1, dimension).collect()
    who, x = np.array([r["query"] for r in near]), np.array([r.v for r in near], np.float64)
    longest = math.sqrt(longest)
    cosine = _products(q[who], x) / np.linalg.norm(q[who], axis=1) / longest
    kth = np.array([cosine[who == i].min() for i in range(len(q))])
    hashes = max(1, min(12, math.ceil(math.log2(max(1, size / BUCKET_ROWS)) / 1.9)))
    while True:
        h = Hashes.drawn(dimension, tables, hashes, longest, seed)
        h.similarity = float(np.clip(np.quantile(kth, 0.25), 0, 0.999))
        own = h.buckets(x)
        # The chance passed when a neighbour's bucket comes, in the table where it comes first.
        passed = np.full(len(x), np.inf)
        for table, (buckets, chances) in enumerate(h.visits(q)):
            before = np.cumsum(chances, axis=1) - chances
            for i in range(len(x)):
                at = np.flatnonzero(buckets[who[i]] == own[table, i])
                if len(at):
                    passed[i] = min(passed[i], before[who[i], at[0]])
        needed = float(np.sort(passed)[min(len(passed) - 1, math.ceil(recall * len(passed)))])
        if needed < np.inf or hashes == 1:
            h.mass = min(1.0, needed + 1e-9)
            return h
        hashes -= 1


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 2,
    recall: float = 0.96,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k nearest of all other rows, found.

    Nearness is the largest inner product, in double precision, ties to the smaller id. Of rows with equal vectors the
    k + 1 smallest ids go into the index: no other can be among the k nearest of any row. Queries with equal vectors are
    searched once. Every row lies in one bucket of each table; a query goes once to each cell (a hash of buckets) with
    the buckets that it visits there. Cells with many rows or queries are cut into blocks, each pair of which is a
    task's group, so a bucket of any size is spread; each block gives a query's k + 1 best, and those are merged.
    `recall` is that of the fit queries (see fit); the rest is found as often, on average.

    Vectors that are null, zero, hold null or non-finite components or are not of the commonest length (ties: the
    shorter) take no part. Rows that share the query's id are its own; rows repeated whole count once. A null id is
    nobody's query, and comes first among ties. No rows or no queries give none; further columns do not matter.
    """
    rows = vectors.select(
        vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    good = F.size("v") > 0
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = rows.where(good & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = lengths.d if lengths else 1
    rows = rows.where(F.size("v") == dimension)
    first = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_first())
    points = written(rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))
    asked = rows.where("asks AND id IS NOT NULL").select("id", "v")
    classes = written(asked.groupBy("v").agg(F.min("id").alias("class")))
    searched = classes.select(F.col("class").alias("id"), "v")
    h = fit(points, searched, dimension, k, tables, recall, seed)
    cells = max(8, points.count() // BLOCK_ROWS)
    kind = points.schema["v"].dataType.simpleString()
    hashed = f"table int, cell int, is_query boolean, buckets array<long>, id long, v {kind}"

    def cell_of(buckets: np.ndarray) -> np.ndarray:
        mixed = (buckets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        return (mixed % np.uint64(cells)).astype(np.int32)

    def batch_of(table: int, cell: np.ndarray, is_query: bool, buckets: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(cell), table, np.int32)), pa.array(cell), pa.array(np.full(len(cell), is_query)), buckets, batch["id"], batch["v"]]
        return pa.RecordBatch.from_arrays(columns, ["table", "cell", "is_query", "buckets", "id", "v"])

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, buckets in enumerate(h.buckets(_matrix(batch["v"], dimension)) if batch.num_rows else ()):
                one_each = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1), pa.int32()), pa.array(buckets))
                yield batch_of(table, cell_of(buckets), False, one_each, batch)

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 32):
                batch = whole.slice(low, 32)
                for table, (buckets, count) in enumerate(h.visited(_matrix(batch["v"], dimension))):
                    who, at = np.nonzero(np.arange(buckets.shape[1]) < count[:, None])
                    names = buckets[who, at]
                    cell = cell_of(names)
                    order = np.lexsort((cell, who))
                    who, cell, names = who[order], cell[order], names[order]
                    new = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(cell) != 0)])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(names)), pa.int32()), pa.array(names))
                    yield batch_of(table, cell[new], True, lists, batch.take(pa.array(who[new])))

    placed = points.select("id", "v").mapInArrow(place_rows, hashed).unionAll(searched.repartition(F.xxhash64("id")).mapInArrow(place_queries, hashed))
    found = _blocks(written(placed)).groupBy("table", "cell", "i", "j").applyInArrow(_in_block(k + 1, dimension), _FOUND)
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    best = found.distinct().withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1).drop("n")
    own = asked.distinct().join(classes, "v").select(F.col("id").alias("query_id"), F.col("class").alias("query"))
    by_query = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    ranked = own.join(best, "query").where(~F.col("id").eqNullSafe(F.col("query_id"))).withColumn("rank", F.row_number().over(by_query))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _blocks(placed: DataFrame) -> DataFrame:
    """placed with the block (i, j) of each row: cells of more than BLOCK_ROWS rows or BLOCK_QUERIES queries have several.

    Rows of part i meet queries of part j in each pair (i, j); a row goes to all j, a query to all i.
    """
    counts = placed.groupBy("table", "cell").agg(F.count_if(~F.col("is_query")).alias("rows"), F.count_if("is_query").alias("queries"))
    parts = counts.select(
        "table", "cell", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("of_rows"), F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("of_queries")
    )
    large = written(parts.where("of_rows > 1 OR of_queries > 1"))
    many = large.count()
    zero = F.lit(0)
    if not many:
        return placed.withColumns({"i": zero, "j": zero})
    joined = placed.join(F.broadcast(large) if many <= BROADCAST_CELLS else large, ["table", "cell"], "left")
    last_i, last_j = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) - 1 for c in ("of_rows", "of_queries"))
    mix = F.abs(F.xxhash64("id", "v") % 1_000_000_007)
    other = F.explode(F.sequence(zero, F.when(F.col("is_query"), last_i).otherwise(last_j))).alias("other")
    own = F.when(F.col("is_query"), mix % (last_j + 1)).otherwise(mix % (last_i + 1)).cast("int").alias("own")
    dealt = joined.select(*placed.columns, other, own)
    i, j = (F.when(F.col("is_query"), a).otherwise(b) for a, b in ((F.col("other"), F.col("own")), (F.col("own"), F.col("other"))))
    return dealt.withColumns({"i": i, "j": j}).drop("other", "own")
