"""Exact, near and substring duplicates against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import components, exact, minhash, substrings

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def out(df, *names):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=key)


def random_texts(n, seed, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:  # a near copy
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.randint(words // 2, words))
        texts.append(" ".join(w))
    return texts


def test_exact_groups_ties_nulls_repeats(docs):
    d = docs((5, "a b"), (3, "ab"), (4, "a\tb "), (9, " a b "), (8, None), (7, ""), (6, " \n"), (None, "ab"), (1, "é b"), (1, "é b"))
    got = out(exact.exact_duplicates(d), "doc_id", "keep_id", "group_size", "kept")
    assert got == [
        (1, 1, 2, True), (1, 1, 2, True), (3, 9, 5, False), (4, 9, 5, False), (5, 9, 5, False),
        (6, 6, 3, True), (7, 6, 3, False), (8, 6, 3, False), (9, 9, 5, True), (None, 9, 5, False),
    ]
    assert out(exact.exact_duplicates(d), "text_sha256", "doc_id")[0][0] == min(hashlib.sha256(t.encode()).hexdigest() for t in ("ab", "", "éb"))


def test_exact_ties_go_to_the_smallest_id(docs):
    assert out(exact.exact_duplicates(docs((2, "a b"), (1, "ab "))), "doc_id", "keep_id") == [(1, 1), (2, 1)]
    assert out(exact.exact_duplicates(docs((-(2**63), "x"), (2**63 - 1, "x"))), "keep_id") == [(-(2**63),)] * 2


def test_one_row_of_each_group_stays(docs):
    d = docs((1, "a b"), (1, "a b"), (1, "a\tb"), (1, "c"), (0, "c"), (None, "d"), (None, "d"), (2, None), (3, ""))
    assert out(exact.drop_exact_duplicates(d), "doc_id", "text")[:1] == [(0, "c")]
    assert [r[0] for r in out(exact.drop_exact_duplicates(d), "doc_id")] == [0, 1, 2, None]
    d = docs((1, "a b c"), (1, "a b c"), (1, "other words here"), (2, "a b c"), (None, "p q"), (None, "p q"), (None, "r s"), (5, None), (6, ""), (6, ""))
    left = minhash.drop_near_duplicates(d, shingle_words=2)
    assert [r[0] for r in out(left, "doc_id")] == [1, 5, 6, None, None] and left.columns == d.columns


def test_exact_both_ways_agree(docs):
    d = docs(*[(i, f"t{i % 7}" if i % 3 else "hot text") for i in range(90)])
    assert out(exact.exact_duplicates(d)) == out(exact.exact_duplicates(d, tracked=32, frequent=1))
    assert exact.exact_duplicates(docs()).count() == 0 and exact.drop_exact_duplicates(d).columns == d.columns
    assert exact.drop_exact_duplicates(d).count() == 8


def plain_components(pairs, k, similar):
    def items(text):
        w = [x for x in SPACES.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: items(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_near_duplicates_match_all_pairs(docs):
    for k, seed in ((2, 1), (5, 2)):
        pairs = list(enumerate(random_texts(120, seed)))
        assert out(minhash.near_duplicates(docs(*pairs), shingle_words=k)) == plain_components(pairs, k, 80)


def test_near_duplicates_within_a_family(docs):
    """Texts that share much, but mostly less than asked for, and a few linked ones among them."""
    rng = random.Random(4)
    core = [f"c{i}" for i in range(60)]
    pairs = [(i, " ".join([*core, *(f"u{rng.randrange(10**6)}" for _ in range(12))])) for i in range(60)]
    pairs += [(100 + i, pairs[7 * i + 3][1] + " tail") for i in range(8)]
    assert out(minhash.near_duplicates(docs(*pairs), shingle_words=2)) == plain_components(pairs, 2, 80)


def test_near_duplicates_edges(docs):
    pairs = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "É two three"), (6, "é two three"), (7, "a b " * 9000), (8, "a b"), (9, " \t")]
    assert out(minhash.near_duplicates(docs(*pairs), shingle_words=2)) == plain_components(pairs, 2, 80)
    got = out(minhash.near_duplicates(docs((3, "x y z"), (None, "x y z"), (None, "p q r"), (2, "x y z"), (2, "x y z"))), "doc_id", "component_id", "kept")
    assert got == [(2, 2, True), (2, 2, True), (3, 2, False), (None, 2, False), (None, None, True)]
    assert minhash.near_duplicates(docs()).count() == 0
    d = docs((1, "a b c d e f"), (2, "a b c d e f"))
    assert out(minhash.drop_near_duplicates(d), "doc_id") == [(1,)] and minhash.drop_near_duplicates(d).columns == d.columns


def test_tensored_tables_find_what_they_promise():
    rng = random.Random(0)
    missed = 0
    for _ in range(150):
        same, own = rng.sample(range(10**9), 89), rng.sample(range(10**9), 22)
        texts = [" ".join(map(str, same + own[i::2])) for i in (0, 1)]
        a, b = (minhash.sub_signatures(minhash.shingles(t, 1)) for t in texts)
        missed += not ((a[0] == b[0]).any() and (a[1] == b[1]).any())
    assert missed == 0


def test_components_of_chains_cycles_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(1, i) for i in range(2, 40)]
    edges = spark.createDataFrame([*chain, (130, 100), *star, (7, 7), (None, 3), (50, 51), (51, 50)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {i: 100 for i in range(100, 131)} | {i: 1 for i in range(1, 40)} | {50: 50, 51: 50}
    assert components.components(edges.where("false")).count() == 0


def plain_substrings(pairs, n):
    words = {i: [w for w in SPACES.split(t or "") if w] for i, t in pairs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    rows = []
    for i, w in sorted(words.items()):
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        rows.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def test_substrings_match_plain_version(docs):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    pairs = []
    for i in range(80):
        w = rng.choices([f"w{j}" for j in range(50)], k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at, a = rng.randint(0, len(w)), rng.randint(0, 12)
            w[at:at] = passage[a : a + rng.randint(5, 18)]
        pairs.append((i * 3 % 83, " ".join(w)))
    pairs += [(200, None), (201, ""), (202, "x " * 400), (203, "x " * 399), (204, pairs[0][1]), (205, "É  é\tñ " * 8), (206, "É é ñ\n" * 8)]
    d, want = docs(*pairs), plain_substrings(pairs, 13)
    for options in ({}, {"hot_rows": 2, "bucket_bytes": 300, "block_bytes": 500}, {"hot_rows": 1}, {"minimiser": 3}, {"minimiser": 13}):
        assert out(substrings.substring_duplicates(d, **options), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert out(substrings.substring_duplicates(d, window=4, minimiser=2), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_substrings(pairs, 4)


def test_substrings_of_rows_that_share_an_id(docs):
    passage = " ".join(f"p{i}" for i in range(20))
    lead, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(90))
    d = docs((1, passage), (4, f"{lead} {passage}"), (4, "short"), (4, other), (4, None), (4, f"{passage} c"), (3, other))
    want = [(1, 0, passage), (3, 0, other), (4, 0, ""), (4, 0, "short"), (4, 20, "c"), (4, 20, lead), (4, 90, "")]
    for options in ({}, {"hot_rows": 1, "bucket_bytes": 300, "block_bytes": 100}):
        assert out(substrings.substring_duplicates(d, keep_text=True, **options), "doc_id", "n_removed", "kept") == sorted(want)


def test_substrings_edges(docs):
    long = " ".join(map(str, range(20)))
    got = out(substrings.substring_duplicates(docs((None, long), (4, long), (4, long), (2, long)), keep_text=True), "doc_id", "n_removed", "kept")
    assert got == [(2, 0, long), (4, 20, ""), (4, 20, ""), (None, 0, long)]
    assert substrings.substring_duplicates(docs()).count() == 0


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"cc", b"d"]), max_size=30), max_size=4), st.booleans())
def test_super_kmers_hold_every_window_once(texts, some_hot):
    n, k, powers = 5, 2, substrings._Powers()
    none = np.empty(0, np.uint32)
    cut = substrings.Cut(texts, n, k, none, powers)
    if some_hot:
        cut = substrings.Cut(texts, n, k, np.sort(cut.number[:2]), powers)
    got, hashes = [], {}
    for doc, start, windows, h, packed in zip(cut.doc.tolist(), cut.start.tolist(), cut.windows.tolist(), cut.hash.tolist(), cut.packed, strict=True):
        w = packed.split(b" ")
        assert len(w) - n + 1 == windows and hashes.setdefault(packed, h) == h
        got += [(doc, start + i, tuple(w[i : i + n])) for i in range(windows)]
    assert sorted(got) == [(d, i, tuple(t[i : i + n])) for d, t in enumerate(texts) for i in range(len(t) - n + 1)]
    numbers = {}
    for number, packed in zip(cut.number.tolist(), cut.packed, strict=True):
        w = packed.split(b" ")
        assert all(numbers.setdefault(tuple(w[i : i + n]), number) == number for i in range(len(w) - n + 1))


def test_equal_hashes_of_different_strings_are_no_repeats():
    hashes, packed, ids = np.array([5, 5, 5, 7, 5], np.uint64), [b"a", b"b", b"a", b"a", b"a"], np.array([4, 1, 3, 9, 3])
    assert substrings._repeated_in_block(hashes, packed, ids).tolist() == [True, False, False, False, False]


def test_a_minimiser_far_larger_than_a_bucket_is_dealt_out(docs, spark):
    """One run of five words with other words around it in every text: its windows do not meet in one bucket."""
    rng = random.Random(11)
    hot = "alpha beta gamma delta epsilon"
    around = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(9))
    pairs = [(i, f"{around()} {hot} {around()}") for i in range(2_000)]
    pairs += [(5_000 + i, pairs[7 * i][1]) for i in range(100)]
    frame = docs(*pairs)
    rows = frame.select("text")
    bucket, size = 4_000, sum(len(t) for _, t in pairs)
    assert size > 50 * bucket
    cells, mask = substrings.hot_cells(rows, 13, 5, 100, size)
    words = [t.encode().split() for _, t in pairs]
    cut = substrings.Cut(words, 13, 5, np.empty(0, np.uint32), substrings._Powers())
    numbers, many = np.unique(cut.number, return_counts=True)
    assert 0 < len(cells) <= 8 and set((numbers[many >= 100] & mask).tolist()) <= set(cells.tolist())
    after = substrings.Cut(words, 13, 5, cells, substrings._Powers(), mask)
    assert np.unique(after.number, return_counts=True)[1].max() < 200  # the 100 copies of a window and its original, at most
    got = out(substrings.substring_duplicates(frame, hot_rows=100, bucket_bytes=bucket, block_bytes=20_000), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain_substrings(pairs, 13)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "e" * 600]), max_size=30), max_size=6), st.integers(1, 40))
def test_cells_hold_every_row(texts, held):
    """Rows of all windows are in the blocks, however often a task sends them."""
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(t) for t in texts] + [None]})
    was, substrings.HELD_ENTRIES = substrings.HELD_ENTRIES, held
    try:
        sent = list(substrings._weighed(3, 2, np.uint32(0x3FFFF))([batch, batch]))
    finally:
        substrings.HELD_ENTRIES = was
    blocks = sorted((r, b) for s in sent for r, b in zip(s["range"].to_pylist(), s["block"].to_pylist(), strict=True))
    merged = pa.RecordBatch.from_arrays([pa.array([r for r, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["range", "block"])
    found = [(c, n) for s in substrings._full_cells(1)([merged]) for c, n in zip(s["cell"].to_pylist(), s["rows"].to_pylist(), strict=True)]
    want = 2 * sum(1 + sum(len(w) + 1 for w in t[i : i + 3]) // substrings.ROW_BYTES for t in texts for i in range(len(t) - 2))
    assert sum(n for c, n in found if c is None) == sum(n for c, n in found if c is not None) == want


def test_candidates_of_a_family_are_nearly_its_links(spark):
    """Texts just under the threshold whose tails draw on few words: candidates grow with the links, not with the pairs."""
    core, tails = [f"c{i}" for i in range(120)], [f"t{i}" for i in range(20)]
    for n in (60, 120):
        rng = random.Random(n)
        texts = [" ".join([*core, *(rng.choice(tails) for _ in range(rng.choice((12, 20, 22))))]) for _ in range(n)]
        sets = [set(minhash.shingles(t, 2).view(np.int64).tolist()) for t in texts]
        linked = {(a, b) for a in range(n) for b in range(a + 1, n) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        of = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<long>").repartition(3)
        met = [(r["a"], r["b"]) for r in minhash._across(of.selectExpr("id", "id AS part"), of, 80).collect()]
        assert len(met) == len(set(met)) and linked <= set(met) and len(met) <= len(linked) + n


def test_candidates_lose_no_link_of_random_sets(spark):
    """Sets of many sizes over few items, in two parts: all pairs across parts that are similar enough are met."""
    for seed, similar in ((1, 80), (2, 60), (3, 95)):
        rng = random.Random(seed)
        sets = [set(rng.sample(range(60), rng.choice((1, 2, 5, 20, 40, 55)))) for _ in range(60)]
        sets += [s - {rng.choice(sorted(s))} | {rng.randrange(60)} for s in sets]
        part = [rng.randrange(3) for _ in sets]
        of = spark.createDataFrame([(i, sorted(s), p) for i, (s, p) in enumerate(zip(sets, part, strict=True))], "id long, items array<long>, part long")
        met = {(r["a"], r["b"]) for r in minhash._across(of.select("id", "part"), of.select("id", "items"), similar).collect()}
        pairs = ((a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if part[a] != part[b])
        assert {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])} <= met


def join_rows(df):
    """The most rows that a join of the plan made."""
    df.collect()
    found, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
            plans.append(plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan())
            continue
        if "Join" in name:
            found.append(plan.metrics().get("numOutputRows").get().value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return max(found)


def test_linked_members_do_not_meet_every_text_beyond_reach(spark):
    """A large component, and texts that share most with it but have too much of their own: few rows meet, and the one link is found."""
    rng = random.Random(5)
    sets = [(i, 0, [*rng.sample(range(140), 137), *(1000 + 3 * i + j for j in range(3))]) for i in range(300)]
    sets += [(i, i, [*rng.sample(range(140), 122), *(10_000 + 18 * i + j for j in range(18))]) for i in range(300, 360)]
    sets.append((360, 360, [*sets[0][2][:130], *range(50_000, 50_010)]))
    of = spark.createDataFrame(sets, "id long, part long, items array<long>").repartition(3)
    met = minhash._across(of.select("id", "part"), of.select("id", "items"), 80)
    assert join_rows(met) <= 2 * sum(len(s) for _, _, s in sets)
    assert {(r["a"], r["b"]) for r in met.collect()} >= {(0, 360)}


def test_small_blocks_are_sent_with_a_dictionary(spark, docs):
    """What is shuffled is well compressed though each of many buckets gets little, and texts come back whole."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(500)]
    pairs = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(300)]
    dictionary = substrings.trained(docs(*pairs).select("text"))
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in pairs], "row": [0] * len(pairs), "text": [t for _, t in pairs]})

    def size(known):
        sent = substrings._sent(13, 5, 400, np.empty(0, np.uint32), np.uint32(0xFFFFFFFF), 1 << 20, known)
        return sum(len(b) for s in sent([batch]) for b in s["block"].to_pylist())

    assert size(dictionary) < 0.9 * size(None)
    packed = next(substrings._packed_texts(dictionary)([batch]))["packed"].to_pylist()
    assert [substrings._unpacker(dictionary)(p).decode() for p in packed] == [t for _, t in pairs]
    assert substrings.trained(docs((1, None)).select("text")) is None
    plan = substrings.substring_duplicates(docs(*pairs))._jdf.queryExecution().executedPlan().toString()
    assert "packed" in plan.split("Join")[1]
