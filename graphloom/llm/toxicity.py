"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_column

#: Buckets that terms are hashed to.
BUCKETS = 1 << 20
CONSTANT = BUCKETS
#: Documented bound: labelled rows that the model is fitted on (in expectation, chosen by a hash of the id).
TRAINING_ROWS = 12_000
#: Rows of a term, or of two together, from which they can be weighed.
LEAST_ROWS = 3
#: Evidence, as twice a log-likelihood ratio: one in a thousand of chance for one term. Pairs are asked for more, by their number.
EVIDENCE = 10.8
#: How far the norm of a term's factors must stand out when all terms are tried, in median deviations.
STANDS_OUT = 6.0
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 25, 128, 0.08, 1e-4
#: Steps of learning, at least and at most.
FEWEST_STEPS, MOST_STEPS = 250, 1_500
#: Trial over all terms: rows at most, steps, and steps for one pass over the rows.
TRIAL_ROWS, TRIAL_STEPS, TRIAL_BATCHES = 5_000, 80, 10
#: Lengths of word beginnings that are terms of their own, so that unseen compounds of a known stem count.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
_MEMO = 200_000
_WORD = re.compile(r"[^\W_]+")


def _buckets(word: str) -> tuple[int, ...]:
    terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(t.encode(errors="surrogatepass")) % BUCKETS for t in terms)


def _distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _evidence(ones: np.ndarray, n: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Twice the log-likelihood ratio of `ones` toxic rows in n against the share expected: 0 where it fits, either way."""
    share, zeros = np.clip(share, 1e-6, 1 - 1e-6), n - ones
    with np.errstate(divide="ignore", invalid="ignore"):
        said = np.where(ones > 0, ones * np.log(ones / (n * share)), 0) + np.where(zeros > 0, zeros * np.log(zeros / (n * (1 - share))), 0)
    return 2 * said


@dataclass
class Rows:
    """Texts as places of their terms in a model, one after the other, each text with 0, the constant, in front."""

    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([np.empty(0, np.int64), *rows]), np.cumsum([0, *map(len, rows)])[:-1])

    def within(self, buckets: np.ndarray) -> Rows:
        """From rows of buckets, with CONSTANT in front of each, to places; buckets that are not among the sorted ones given are left out."""
        place = np.full(BUCKETS + 1, -1, np.int32)
        place[buckets], place[CONSTANT] = np.arange(1, len(buckets) + 1), 0
        flat = place[self.flat]
        known = flat >= 0
        sizes = np.add.reduceat(known, self.starts, dtype=np.int64) if len(self.starts) else self.starts
        return Rows(flat[known], np.cumsum(sizes) - sizes)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.flat))

    def take(self, which: np.ndarray) -> Rows:
        sizes = self.sizes[which]
        starts = np.cumsum(sizes) - sizes
        return Rows(self.flat[np.repeat(self.starts[which] - starts, sizes) + np.arange(sizes.sum())], starts)


@dataclass
class FactorizationMachine:
    """score = sigmoid(w0 + sum w[i] + sum over pairs <v[i], v[j]>) over a text's distinct weighed buckets."""

    buckets: np.ndarray  # sorted
    linear: np.ndarray  # the first is w0
    factors: np.ndarray

    @classmethod
    def fresh(cls, buckets: np.ndarray, share: float) -> FactorizationMachine:
        """Knows the share of toxic rows only; small factors, from which learning goes on."""
        n = len(buckets)
        factors = np.vstack([np.zeros(FACTORS), np.random.default_rng(1).normal(0, 0.05, (n, FACTORS))])
        return cls(buckets, np.array([np.log(share / (1 - share)), *np.zeros(n)], np.float32), factors.astype(np.float32))

    def reader(self) -> Callable[[str | None], np.ndarray]:
        """From a text to the places of its terms in the model, with 0, the constant, in front."""
        index = {b: i for i, b in enumerate(self.buckets.tolist(), 1)}
        memo: dict[str, tuple[int, ...]] = {}

        def read(text: str | None) -> np.ndarray:
            found = {0}
            for word in _distinct_words(text):
                places = memo.get(word)
                if places is None:
                    places = tuple(index[b] for b in _buckets(word) if b in index)
                    if len(memo) < _MEMO:
                        memo[word] = places
                if places:
                    found.update(places)
            return np.array(sorted(found), np.int64)

        return read

    def logits(self, rows: Rows) -> np.ndarray:
        if not len(rows.starts):
            return np.empty(0)
        v = self.factors[rows.flat]
        total, squares = np.add.reduceat(v, rows.starts), np.add.reduceat((v * v).sum(axis=1), rows.starts)
        return np.add.reduceat(self.linear[rows.flat], rows.starts) + 0.5 * ((total**2).sum(axis=1) - squares)

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))

    def gradients(self, rows: Rows, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows' mean logistic loss, by linear weights and by factors."""
        sizes, n = rows.sizes, len(self.linear)
        v = self.factors[rows.flat]
        total = np.repeat(np.add.reduceat(v, rows.starts), sizes, axis=0)
        error = np.repeat(self.scores(rows) - labels, sizes) / len(labels)
        by_factor = error[:, None] * (total - v)
        return (
            np.bincount(rows.flat, error, minlength=n),
            np.stack([np.bincount(rows.flat, by_factor[:, f], minlength=n) for f in range(FACTORS)], axis=1),
        )

    def learn(self, rows: Rows, labels: np.ndarray, steps: int, batch: int, rate: float = RATE, factor_rate: float = 0.3 * RATE) -> None:
        """Adaptive gradient descent on the logistic loss, in batches, pass after pass."""
        rng = np.random.default_rng(3)
        seen_w, seen_v = np.full_like(self.linear, 1e-8), np.full_like(self.factors, 1e-8)
        order = np.empty(0, np.int64)
        for _ in range(steps):
            if not len(order):
                order = rng.permutation(len(labels))
            now, order = order[:batch], order[batch:]
            grad_w, grad_v = self.gradients(rows.take(now), labels[now])
            grad_w += DECAY * self.linear
            grad_v += DECAY * self.factors
            seen_w += grad_w**2
            seen_v += grad_v**2
            self.linear -= rate * grad_w / np.sqrt(seen_w)
            self.factors -= factor_rate * grad_v / np.sqrt(seen_v)


def _learnt(buckets: np.ndarray, texts: Rows, labels: np.ndarray) -> FactorizationMachine:
    model = FactorizationMachine.fresh(buckets, labels.mean())
    model.learn(texts.within(buckets), labels, min(MOST_STEPS, max(FEWEST_STEPS, EPOCHS * -(-len(labels) // BATCH))), BATCH)
    return model


def _standing_out(buckets: np.ndarray, texts: Rows, labels: np.ndarray) -> np.ndarray:
    """Buckets that a machine over all of them gives factors far larger than to most: those whose pairs it uses."""
    trial = FactorizationMachine.fresh(buckets, labels.mean())
    if len(labels) > TRIAL_ROWS:
        some = np.random.default_rng(2).permutation(len(labels))[:TRIAL_ROWS]
        texts, labels = texts.take(some), labels[some]
    trial.learn(texts.within(buckets), labels, TRIAL_STEPS, -(-len(labels) // TRIAL_BATCHES), factor_rate=0.6 * RATE)
    norms = np.linalg.norm(trial.factors[1:], axis=1)
    middle = np.median(norms)
    return buckets[norms > middle + STANDS_OUT * np.median(np.abs(norms - middle))]


def _paired(
    tried: np.ndarray, others: np.ndarray, texts: Rows, labels: np.ndarray, expected: np.ndarray
) -> np.ndarray:
    """Buckets of `tried` that together with another, of either list, tell of the label what `expected` does not."""
    both, pairs = np.union1d(tried, others), len(tried) * (len(tried) + len(others))
    rows, found = texts.within(both), []
    for block in np.array_split(np.searchsorted(both, tried), -(-len(tried) // 256)) if len(tried) else []:
        n, ones, share = np.zeros((3, len(block), len(both)), np.float32)
        for at in range(0, len(labels), 1024):
            part = rows.take(np.arange(at, min(len(labels), at + 1024)))
            here = np.zeros((len(part.starts), len(both) + 1), np.float32)
            here[np.repeat(np.arange(len(part.starts)), part.sizes), part.flat] = 1
            here = here[:, 1:]
            left = here[:, block].T
            n += left @ here
            ones += (left * labels[at : at + 1024].astype(np.float32)) @ here
            share += (left * expected[at : at + 1024].astype(np.float32)) @ here
        told = _evidence(ones, np.maximum(n, 1), share / np.maximum(n, 1))
        told[np.arange(len(block)), block] = 0
        strong = (told > EVIDENCE + 2 * np.log(pairs)) & (n >= LEAST_ROWS)
        found += [block[strong.any(axis=1)], np.flatnonzero(strong.any(axis=0))]
    return both[np.unique(np.concatenate([np.empty(0, np.int64), *found]))]


def machine(texts: Rows, labels: np.ndarray) -> FactorizationMachine:
    """Learns from texts, as CONSTANT and their distinct buckets, and labels, both 0 and 1 among them.

    All terms of LEAST_ROWS rows take part. Weighed in the end are those that tell of the label by themselves, for
    or against it, and those that tell in a pair: a trial machine over all terms shows whose pairs it uses, and
    pairs of these and of the first kind are held against what the terms say one by one. Without this, weights of
    tens of thousands of rare terms learn the sample by heart.
    """
    n = np.bincount(texts.flat, minlength=BUCKETS + 1)[:BUCKETS]
    ones = np.bincount(texts.flat[np.repeat(labels > 0, texts.sizes)], minlength=BUCKETS + 1)[:BUCKETS]
    often = np.flatnonzero(n >= LEAST_ROWS)
    n, ones, share = n[often], ones[often], labels.mean()
    told = _evidence(ones, n, share) + _evidence(labels.sum() - ones, np.maximum(len(labels) - n, 1), share)
    alone = often[told > EVIDENCE]
    model = _learnt(alone, texts, labels)
    tried = np.setdiff1d(_standing_out(often, texts, labels), alone) if len(often) else alone
    expected = np.clip(model.scores(texts.within(alone)), share / 2, 1 - (1 - share) / 2)
    both = np.union1d(alone, _paired(tried, alone, texts, labels, expected))
    return model if len(both) == len(alone) else _learnt(both, texts, labels)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[CONSTANT, *sorted({b for w in _distinct_words(t) for b in _buckets(w)})] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"label": batch["label"], "terms": pa.array(rows, pa.list_(pa.int32()))})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    training_rows: int = TRAINING_ROWS,
) -> FactorizationMachine:
    """Learns from the labelled documents, or about `training_rows` of them chosen by a hash of the id.

    Labels other than 0 and 1, null ids and labels without a document are left out; an id with several labels or
    texts counts with each. Without both labels the model says the share of ones (0 without any rows) for every
    text. The driver gets the sample's hashed terms, four bytes each.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
    marked = marked.where("id IS NOT NULL AND label IN (0, 1)")
    n = marked.count()
    few = n <= training_rows
    if not few:
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * training_rows / n))
        few = marked.count() <= 2 * training_rows
    rows = (
        docs.select(docs[id_col].alias("id"), text_column(docs, text_col).alias("text"))
        .join(F.broadcast(marked) if few else marked, "id")
        .select("label", "text")
        .mapInArrow(_hashed, "label int, terms array<int>")
        .toArrow()
    )
    marks = rows["label"].to_numpy().astype(float)
    if not marks.any() or marks.all():
        share = marks.mean() if len(marks) else 0.0
        return FactorizationMachine(np.empty(0, np.int64), np.array([60.0 * share - 30]), np.zeros((1, FACTORS)))
    # The rows come in any order: put them in one that depends on what they hold alone.
    texts = [t for chunk in rows["terms"].chunks for t in _each(chunk)]
    order = np.lexsort(([xxhash.xxh3_64_intdigest(t) for t in texts], marks))
    texts, marks = [texts[i] for i in order.tolist()], marks[order]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    return machine(Rows(np.concatenate(texts), starts), marks)


def _each(lists: pa.ListArray) -> list[np.ndarray]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs: 0 to 1, of the whole text; null and empty texts get the constant's score.

    Repeated and null ids are rows like any other, and an empty table gives none. Other columns are ignored.
    Rows are scored where they are read; the model (at most BUCKETS of weights, as a rule hundreds) goes with the task.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            terms = list(map(read, batch["text"].to_pylist()))
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "score": pa.array(model.scores(Rows.of(terms)), pa.float64())})

    rows = docs.select(docs[id_col].alias("id"), text_column(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)


def is_held_out(id_) -> F.Column:
    """Whether the label of this id is kept from learning: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs, by a model of the labels that are not held out.

    Null and empty texts get the constant's score; null ids are not held out; repeated ids and rows are scored row by
    row. Labels as in fit. Empty table: no rows. Other columns are ignored.
    """
    model = fit(docs, labels.where(~is_held_out(labels[id_col])), id_col, text_col, label_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(
        id_col,
        is_held_out(scored[id_col]).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """docs, in its own columns, without rows whose own text scores THRESHOLD or more.

    Each row is judged by itself, whatever its id: null and repeated ids, repeated rows and other columns make no
    difference, and null and empty texts get the constant's score. Empty table: no rows.
    """
    model = fit(docs, labels.where(~is_held_out(labels[id_col])), id_col, text_col, label_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            terms = list(map(read, batch.column(text_col).to_pylist()))
            yield batch.filter(pa.array(model.scores(Rows.of(terms)) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
