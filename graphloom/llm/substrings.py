"""Substring de-duplication: word windows partitioned as super-k-mers by their minimisers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_column, written

WINDOW = 13
#: Words whose joint hash a minimiser is the least of.
MINIMISER = 5
#: Bytes of text for one bucket, buckets for one partition, and the most partitions that buckets are dealt to.
BUCKET_BYTES = 4 << 20
BUCKETS_EACH = 2
PARTITIONS = 50_000
#: Rows that one minimiser may bring to a task; beyond that its windows are dealt out one by one. A row is a window, or
#: ROW_BYTES of it, so this is 16 MiB of windows written out.
HOT_ROWS, ROW_BYTES = 60_000, 256
#: Rows are counted in a table of cells: the bits of the least and the largest one, how many cells' mean an unmarked cell
#: may hold beyond HOT_ROWS, and the bits of a range of cells that is summed together. At most 2 ** 28 / HOT_MEANS cells
#: are marked, at any size of the input.
CELL_BITS, HOT_MEANS, RANGE_BITS = (16, 28), 8, 16
#: Entries of the table that a task holds before it sends them.
HELD_ENTRIES = 1 << 21
#: Bytes of super-k-mers that are combined and compressed together before they are sent, and of text that is cut at once.
BLOCK_BYTES = 24 << 20
PORTION_BYTES = 1 << 20
#: What is shuffled is compressed at this level, with a dictionary of so many bytes trained on the beginnings of some texts.
#: Any sample serves: it changes sizes only. Blocks get small as buckets get many, and then have little to learn from.
LEVEL, DICTIONARY_BYTES, SAMPLED_TEXTS, SAMPLED_CHARS, PIECE_CHARS = 6, 112_640, 1_000, 2_000, 250
_MULT, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_LOW = np.uint64(0xFFFFFFFF)
_LOW32 = np.uint32(0xFFFFFFFF)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.repeat(np.array([_BASE, pow(_BASE, -1, 2**64)], np.uint64)[:, None], 2 * n, axis=1)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1)
        return self.up[:n], self.down[:n]


class Cut:
    """Super-k-mers of several texts: the document and first word of each, its minimiser's number, a hash, and its string.

    hot: sorted cells, the low bits of numbers, whose windows travel alone.
    """

    def __init__(self, texts: list[list[bytes]], window: int, k: int, hot: np.ndarray, powers: _Powers, mask: np.uint32 = _LOW32):
        words = [w for text in texts for w in text]
        counts = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(counts)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        places, numbers = _minimisers(hashes, np.repeat(ends, counts), window, k)
        at = _run_starts(places, numbers)
        first, number, windows = places[at], numbers[at], np.diff(at, append=len(places))
        up, down = powers(len(words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(words)], dtype=np.uint64)])

        def hashed(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            return _mix((sums[end] - sums[begin]) * down[begin])

        alone = _member(number & mask, hot)
        if alone.any():  # each window by itself, under a number of its own words
            many = windows[alone]
            each = np.repeat(first[alone], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            own = (hashed(each, each + window) & _LOW).astype(np.uint32)
            first, number = np.concatenate([first[~alone], each]), np.concatenate([number[~alone], own])
            windows = np.concatenate([windows[~alone], np.ones(len(each), np.int64)])
        end = first + windows + window - 1
        self.doc = np.searchsorted(ends, first, "right")
        self.start = first - (ends - counts)[self.doc]
        self.number, self.windows, self.hash = number, windows, hashed(first, end)
        joined = b" ".join(words)
        begins = np.cumsum(np.fromiter((0, *map(len, words)), np.int64, len(words) + 1)) + np.arange(len(words) + 1)
        self.packed = [joined[a:b] for a, b in zip(begins[first].tolist(), (begins[end] - 1).tolist(), strict=True)]


def _minimisers(hashes: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows, by first word, and for each a 32-bit number that depends on its least run of k words.

    ends: for each word where its text ends.
    """
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    least = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        least = (least ^ (least >> np.uint64(31))) * _MULT + hashes[j : n - k + 1 + j]
    least, size, wanted = _mix(least), 1, window - k + 1
    while size < wanted:
        step = min(size, wanted - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    places = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= window)
    return places, (least[places] & _LOW).astype(np.uint32)


def _run_starts(places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring windows with one number begin."""
    if not len(places):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (numbers[1:] != numbers[:-1])]))


def _portions(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[list, ...]]:
    """The batch's rows in portions of about PORTION_BYTES of text: words of each text, and the named columns."""
    portion, held = [], 0
    for row in zip(*(batch[n] for n in ("text", *names)), strict=True):  # one by one: a batch may have many long texts
        text, *others = (x.as_py() for x in row)
        portion.append((_words(text), *others))
        held += len(text or "")
        if held >= PORTION_BYTES:
            yield tuple(map(list, zip(*portion, strict=True)))
            portion, held = [], 0
    if portion:
        yield tuple(map(list, zip(*portion, strict=True)))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _summed(cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the sum of the rows of each."""
    order = np.argsort(cells, kind="stable")
    cells, rows = cells[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
    return cells[at], np.add.reduceat(rows, at) if len(at) else rows


def _weighed(window: int, k: int, mask: np.uint32):
    """Texts to (range, block): the rows that each cell would bring to a task, packed by ranges of cells."""

    def weigh(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([len(t) for t in texts], np.int64)
        words = [w for t in texts for w in t]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        places, numbers = _minimisers(hashes, np.repeat(np.cumsum(counts), counts), window, k)
        if not len(places):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ends = np.cumsum(np.fromiter((0, *(len(w) + 1 for w in words)), np.int64, len(words) + 1))
        return _summed(numbers & mask, 1 + (ends[places + window] - ends[places]) // ROW_BYTES)

    def packed(cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        ranges = cells >> np.uint32(RANGE_BITS)
        edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(cells) else np.array([0])
        pack = zstandard.ZstdCompressor(level=3).compress
        low, many = cells.astype("<u2"), np.minimum(rows, _LOW32).astype("<u4")
        blocks = [pack(low[lo:hi].tobytes() + many[lo:hi].tobytes()) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[edges[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], ["range", "block"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for (texts,) in _portions(batch):
                held.append(weigh(texts))
                size += len(held[-1][0])
                if size >= 2 * HELD_ENTRIES:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= HELD_ENTRIES:
                        yield packed(*held.pop())
                        size = 0
        if held:
            yield packed(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return send


def _full_cells(hot_rows: int):
    """Blocks, sorted by range, to (cell, rows): cells of hot_rows and more; and with a null cell the rows of a range."""

    def full(number: int, rows: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(rows >= hot_rows)
        cells = [*((number << RANGE_BITS) + at).tolist(), None]
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([*rows[at].tolist(), int(rows.sum())], pa.int64())], ["cell", "rows"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, np.zeros(1 << RANGE_BITS, np.int64)
        for batch in batches:
            for number, block in zip(batch["range"].to_pylist(), batch["block"], strict=True):
                if number != now and now is not None:
                    yield full(now, rows)
                    rows[:] = 0
                now = number
                raw = zstandard.ZstdDecompressor().decompress(block.as_py())
                n = len(raw) // 6
                rows[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        if now is not None:
            yield full(now, rows)

    return add_up


def hot_cells(rows: DataFrame, window: int, minimiser: int, hot_rows: int, size: int) -> tuple[np.ndarray, np.uint32]:
    """(sorted cells, mask): the low bits of minimisers' numbers that would bring too many rows to one task.

    Every text is counted. A cell adds up all numbers with its bits, so no number with too many rows escapes; one
    that shares a cell is marked without need, which only decides how its windows travel. The table of cells grows with the
    bytes of text up to 2 ** 28; beyond, an unmarked cell may hold HOT_MEANS times the mean of all.
    """
    low, high = CELL_BITS
    bits = min(max(math.ceil(math.log2(max(64 * size / 6 / hot_rows, 1))), low), high)
    mask = np.uint32((1 << bits) - 1)
    blocks = rows.select("text").mapInArrow(_weighed(window, minimiser, mask), "range int, block binary")
    dealt = blocks.repartition(1 << (bits - RANGE_BITS), "range").sortWithinPartitions("range")
    counted = written(dealt.mapInArrow(_full_cells(hot_rows), "cell long, rows long"))
    total = counted.where("cell IS NULL").agg(F.sum("rows")).first()[0] or 0
    found = counted.where("cell IS NOT NULL").where(F.col("rows") >= HOT_MEANS * total / (1 << bits)).select("cell").toArrow()
    return np.sort(found["cell"].to_numpy()).astype(np.uint32), mask


def trained(rows: DataFrame) -> bytes | None:
    """A dictionary for texts like those of rows; None if they are too few to tell."""
    heads = [r.text for r in rows.select(F.substring("text", 1, SAMPLED_CHARS).alias("text")).where("text != ''").limit(SAMPLED_TEXTS).collect()]
    pieces = [t[i : i + PIECE_CHARS].encode(errors="surrogatepass") for t in heads for i in range(0, len(t), PIECE_CHARS)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return None


def _packer(dictionary: bytes | None) -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=LEVEL, **_with(dictionary)).compress


def _unpacker(dictionary: bytes | None) -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor(**_with(dictionary)).decompress


def _with(dictionary: bytes | None) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _pack_block(columns: list[np.ndarray], packed: list[bytes], pack: Callable[[bytes], bytes]) -> bytes:
    parts = [np.ascontiguousarray(x, t).tobytes() for x, t in zip(columns, ("<i8", "<i8", "<i4", "<u4"), strict=True)]
    lengths = np.array([len(p) for p in packed], "<i4").tobytes()
    return pack(b"".join([np.array([len(packed)], "<i8").tobytes(), *parts, lengths, *packed]))


def _unpack_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(ids, rows, starts, numbers, where each string begins, and ends, strings)."""
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    columns, at = [], 8
    for kind in ("<i8", "<i8", "<i4", "<u4", "<i4"):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    ids, rows, starts, numbers, lengths = columns
    return ids, rows, starts, numbers, np.concatenate([[0], np.cumsum(lengths)]) + at, raw


def _repeated_in_block(hashes: np.ndarray, packed: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Marks super-k-mers whose string another of a smaller id has too. Strings are compared where hashes are equal."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    met = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]) if len(order) else order
    least: dict[bytes, int] = {}
    for i in met.tolist():
        least[packed[i]] = min(least.get(packed[i], ids[i]), ids[i])
    out = np.zeros(len(hashes), bool)
    out[met] = [ids[i] > least[packed[i]] for i in met.tolist()]
    return out


def _sent(window: int, k: int, buckets: int, hot: np.ndarray, mask: np.uint32, block_bytes: int, dictionary: bytes | None):
    """Documents to rows (bucket, block): super-k-mers for the buckets, and windows already known to repeat.

    Of equal super-k-mers of a block only those of the least id are sent on; the others repeat them, and go as
    marks (block, with no string) to a bucket by their id. So what a task sends of a very common passage does
    not grow with the number of documents that have it.
    """

    def flush(held: list[tuple], pack: Callable[[bytes], bytes]) -> pa.RecordBatch:
        ids, rows, starts, numbers, windows, hashes = (np.concatenate(c) for c in zip(*(h[:-1] for h in held), strict=True))
        packed = [p for h in held for p in h[-1]]
        known = _repeated_in_block(hashes, packed, ids)
        to = np.where(known, _mix(ids.astype(np.uint64)) & _LOW, numbers.astype(np.uint64) * np.uint64(0x9E3779B1) & _LOW) * np.uint64(buckets) >> np.uint64(32)
        told = np.where(known, windows, numbers)
        order = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(to[order].astype(np.int64)) != 0, [True]]))
        names, blocks = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[lo:hi]
            names.append(int(to[at[0]]))
            strings = [b"" if r else packed[i] for i, r in zip(at.tolist(), known[at].tolist(), strict=True)]
            blocks.append(_pack_block([ids[at], rows[at], starts[at], told[at]], strings, pack))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pack, held, size = _Powers(), _packer(dictionary), [], 0
        for batch in batches:
            for texts, ids, rows in _portions(batch, "id", "row"):
                cut = Cut(texts, window, k, hot, powers, mask)
                if cut.packed:
                    held.append((np.array(ids, np.int64)[cut.doc], np.array(rows, np.int64)[cut.doc], cut.start, cut.number, cut.windows, cut.hash, cut.packed))
                    size += sum(map(len, cut.packed))
                if size >= block_bytes:
                    yield flush(held, pack)
                    held, size = [], 0
        if held:
            yield flush(held, pack)

    return send


def _repeats(window: int, dictionary: bytes | None):
    """Blocks, sorted by bucket, to (id, row, first, last): runs of windows that also start in a smaller id.

    One bucket is held at a time.
    """

    def of_number(entries: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        """entries: id, row, start, string of one number. Sorts their windows; yields (id, row, place of the window)."""
        windows = []
        for id_, row, start, packed in entries:
            words = packed.split(b" ")
            windows += [(b" ".join(words[i : i + window]), id_, row, start + i) for i in range(len(words) - window + 1)]
        windows.sort()
        text, least = None, 0
        for packed, id_, row, place in windows:
            if packed != text:
                text, least = packed, id_
            elif id_ > least:
                yield id_, row, place

    def runs(found: np.ndarray) -> pa.RecordBatch:
        """(id, row, place) to runs of neighbouring places."""
        if len(found):
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] > found[:-1, 2] + 1)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(found)]]) - 1
            found = np.column_stack([found[first], found[last, 2]])
        else:
            found = np.empty((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], ["id", "row", "first", "last"])

    def of_bucket(blocks: list[bytes], unpack: Callable[[bytes], bytes]) -> pa.RecordBatch:
        ids, rows, starts, numbers, block_of, begins, ends, raws = [], [], [], [], [], [], [], []
        found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        for block in blocks:
            i, r, s, n, at, raw = _unpack_block(unpack(block))
            real = at[1:] > at[:-1]
            if not real.all():  # marks: the number says how many windows
                many = n[~real].astype(np.int64)
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.column_stack([np.repeat(i[~real], many), np.repeat(r[~real], many), np.repeat(s[~real].astype(np.int64), many) + within]))
            ids.append(i[real]), rows.append(r[real]), starts.append(s[real]), numbers.append(n[real])
            begins.append(at[:-1][real]), ends.append(at[1:][real])
            block_of.append(np.full(real.sum(), len(raws)))
            raws.append(raw)
        i, r, s, n, o, b, e = map(np.concatenate, (ids, rows, starts, numbers, block_of, begins, ends))
        order = np.argsort(n, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(n[order].astype(np.int64)) != 0, [True]])) if len(n) else np.array([0])
        groups = np.flatnonzero(np.diff(edges) > 1)  # numbers that one super-k-mer has repeat nothing elsewhere
        for lo, hi in zip(edges[groups].tolist(), edges[groups + 1].tolist(), strict=True):
            group = order[lo:hi]
            if (i[group] != i[group[0]]).any():
                entries = [(int(i[x]), int(r[x]), int(s[x]), raws[o[x]][b[x] : e[x]]) for x in group.tolist()]
                if places := list(of_number(entries)):
                    found.append(np.array(places, np.int64))
        return runs(np.concatenate(found))

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, blocks = _unpacker(dictionary), None, []
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"], strict=True):
                if bucket != now and blocks:
                    yield of_bucket(blocks, unpack)
                    blocks = []
                now = bucket
                blocks.append(block.as_py())
        if blocks:
            yield of_bucket(blocks, unpack)

    return repeats


def repeated_windows(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    minimiser: int = MINIMISER,
    bucket_bytes: int = BUCKET_BYTES,
    hot_rows: int = HOT_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, row, first, last): runs of windows, by the place of their first word, that also start in a smaller id.

    row is the XXH64 of the text, and tells rows of one id apart.

    The number of buckets follows the bytes of text. What each minimiser would bring to a task is counted first, over all
    documents, in a table of bounded size; windows of those that would bring too much travel alone, to buckets by
    their own words, so that no bucket gets a common line's whole neighbourhood. Partitions are sorted by bucket, and a
    task holds one bucket: its text, and a number's windows, of which hot_rows are allowed (up to about 25 TB of text;
    then the allowance grows with it, to about eight times that at 100 TB).
    """
    if window < minimiser:
        raise ValueError("window must have as many words as a minimiser at least")
    rows = docs.where(docs[id_col].isNotNull()).select(
        docs[id_col].cast("long").alias("id"), text_column(docs, text_col).alias("text")
    ).withColumn("row", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    hot, mask = hot_cells(rows, window, minimiser, hot_rows, size)
    dictionary = trained(rows)
    sent = rows.mapInArrow(_sent(window, minimiser, buckets, hot, mask, block_bytes, dictionary), "bucket int, block binary")
    dealt = sent.repartition(min(math.ceil(buckets / BUCKETS_EACH), PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_repeats(window, dictionary), "id long, row long, first long, last long")


def _packed_texts(dictionary: bytes | None):
    """Rows (id, row, text) to (id, row, packed): texts go through the shuffle compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _packer(dictionary)
        for batch in batches:
            blocks = pa.array([packed(text.as_py().encode(errors="surrogatepass")) for text in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], blocks], ["id", "row", "packed"])

    return pack


def _kept(window: int, keep_text: bool, dictionary: bytes | None):
    """Rows (id, packed, runs) to (id, n_words, n_removed, kept_sha256, kept)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary)
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for packed, runs in zip(batch["packed"], batch["runs"].to_pylist(), strict=True):
                words = unpack(packed.as_py()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for run in runs or ():
                    gone[run["first"]] += 1
                    gone[min(run["last"] + window, len(words))] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode(errors="surrogatepass") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(texts, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return keep


def substring_duplicates(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options
) -> DataFrame:
    """One row for each row of docs: (id, n_words, n_removed, kept_sha256, kept).

    Words are runs without `[\\x20\\x09-\\x0D]`, unchanged. A word is removed when a window of `window` words
    that covers it also starts in a document with a smaller id, whatever becomes of that document. kept is the
    text of the other words, one space between them (null unless keep_text).

    Null and short texts lose nothing. Rows with a null id lose nothing, and take nothing from others. Rows
    with the same id lose nothing to each other, and each loses what it repeats of smaller ids.
    Empty table: no rows. Other columns are ignored. The id must be an integer.
    """
    runs = written(repeated_windows(docs, window, id_col, text_col, **options))
    by_doc = runs.groupBy(F.col("id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    dictionary = trained(rows)
    packed = rows.select("id", F.xxhash64("text").alias("row"), "text").mapInArrow(_packed_texts(dictionary), "id long, row long, packed binary")
    joined = packed.join(by_doc, (F.col("id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select("id", "packed", "runs")
    out = joined.mapInArrow(
        _kept(window, keep_text, dictionary), "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return out.withColumnRenamed("id", id_col)
