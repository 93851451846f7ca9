"""Secrets, licenses, benchmark passages and toxicity against plain versions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import decontam, licenses, secrets, toxicity


def out(df, *names):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=key)


WORDS = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apı_key", "ſecret", "Ttoken", "K", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "é", "\n", "İ"]


@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_spans_match_plain_patterns(pieces):
    text = "".join(pieces)
    assert [s for s in secrets.find_spans(text, secrets._keywords()) if s[0] in secrets.KINDS[:3]] == plain_spans(text)


def test_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secrets.BASE62[d] + check
    text = f"x ghp_{body}{check} npm_{body}{check} ghp_{body}AAAAAA"
    assert secrets.find_spans(text, secrets._keywords()) == [("github", 2, 42), ("npm", 43, 83)]


def test_secret_report_rows(docs):
    d = docs((1, None), (2, ""), (None, 'é token = "abcdef"'), (3, "a" * 24 + " " + "x" * 100_000), (3, "a" * 24))
    got = out(secrets.secret_report(d), "doc_id", "n_assign", "n_access", "n_hex", "spans")
    assert got == [(1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 0, 0, 1, "hex:0:24"), (3, 0, 0, 1, "hex:0:24"), (None, 1, 0, 0, "assign:2:17")]
    assert {r[0] for r in out(secrets.secret_report(d.where("doc_id = 1")), "base_sha256")} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.secret_report(docs()).count() == 0
    masked = secrets.mask_secrets(docs((1, "a token: abcdef0123456789abcdef0123 b"), (2, None)))
    assert out(masked, "doc_id", "text") == [(1, "a [SECRET] b"), (2, None)]


def test_licenses(docs):
    mit = licenses.TEMPLATES["MIT-grant"]
    near = mit.replace("person", "human").replace("free of charge", "free of any charge")
    d = docs((1, "x y. Licensed under the Apache License, Version 2.0. z"), (2, f"é {near} w"), (3, None), (4, ""), (5, "under the license"), (None, "RELEASED UNDER THE MIT LICENSE"), (6, "w " * 30_000))
    got = out(licenses.license_report(d), "doc_id", "licenses", "spans")
    assert [g[:2] for g in got] == [(1, "Apache-2.0"), (2, "MIT-grant"), (3, ""), (4, ""), (5, ""), (6, ""), (None, "MIT")]
    assert got[0][2] == "Apache-2.0:5:51:8:8" and got[6][2] == "MIT:0:30:5:5"
    name, start, end, matched, words = got[1][2].split(":")
    assert (int(start), int(end)) == (2, 2 + len(near)) and int(matched) == int(words) - 1
    assert licenses.license_report(docs()).count() == 0 and out(licenses.license_report(d, {}), "n_licenses") == [(0,)] * 7


def plain_best(template, words):
    """Score and matches of the best local alignment, without a band."""
    rows, best = [[(0, 0)] * (len(words) + 1)], (0, 0)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            hit = t == w
            s, m = rows[-1][j]
            cell = max((s + (2 if hit else -1), m + hit), (rows[-1][j + 1][0] - 1, rows[-1][j + 1][1]), (row[j][0] - 1, row[j][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
        rows.append(row)
        best = max(best, max(row))
    return best


def test_banded_alignment_matches_whole_alignment():
    rng = random.Random(1)
    for _ in range(60):
        template = rng.choices("abcdefgh", k=rng.randint(3, 25))
        copy = [w for w in template if rng.random() > 0.1]
        lead = rng.randint(0, 10)
        words = ["-"] * lead + copy + ["-"] * 3
        matched, first, last = licenses.align(template, words, lead)
        if len(template) - len(copy) <= licenses.BAND:
            assert matched == plain_best(template, words)[1]
        assert not matched or (lead <= first <= last < lead + len(copy))


def named(text, templates=licenses.TEMPLATES):
    return [m.license for m in licenses.find_licenses(text, licenses.build_index(templates), {})]


def test_whole_license_texts():
    index = licenses.build_index(licenses.TEMPLATES)
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "EPL-1.0", "Unlicense"):
        whole = licenses.TEMPLATES[f"{name}-text"]
        (m,) = licenses.find_licenses(f"{'é ' * 40}{whole.strip()} and more", index, {})
        assert (m.license, m.start, m.matched) == (f"{name}-text", 80, m.words) and m.end >= 80 + len(whole.strip()) - 3
    for name in ("AGPL-3.0-header", "GPL-2.0-header", "LGPL-3.0-header", "CC-BY-SA-4.0", "CC-BY-4.0"):
        assert named(licenses.TEMPLATES[name]) == [name]


def test_short_notices_with_a_word_changed_and_repeats():
    words = licenses.TEMPLATES["MIT"].split()
    for i in range(len(words)):
        # The word that names the license may not be another.
        expected = [] if words[i] == "MIT" else ["MIT"]
        assert named(" ".join([*words[:i], "zzz", *words[i + 1 :]])) == expected
        assert named(" ".join([*words[:i], *words[i + 1 :]])) == expected
    assert named("All rights reserved. " * 3) == ["All-rights-reserved"] * 3
    assert named(f"{licenses.TEMPLATES['MIT']}. " * 4) == ["MIT"] * 4


SHORT = ("MIT", "Apache-2.0", "CC-BY-NC-4.0", "All-rights-reserved", "GPL-2.0", "CC-BY-SA-4.0", "MPL-2.0")


@given(st.lists(st.sampled_from(SHORT), max_size=8), st.lists(st.sampled_from(["", "one", "two words", "é, three more words"]), min_size=9, max_size=9))
def test_notices_one_after_another_are_all_found(names, between):
    """With or without words between them, and the same one several times over."""
    text = between[0]
    for name, gap in zip(names, between[1:], strict=False):
        text += f" {licenses.TEMPLATES[name]}. {gap}"
    found = licenses.find_licenses(text, SHORT_INDEX, {})
    assert [m.license for m in found] == names and all(m.matched == m.words for m in found)


SHORT_INDEX = licenses.build_index(licenses.TEMPLATES)


def test_found_wherever_a_plain_alignment_finds():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(3, 40)
        template = [f"t{rng.randint(0, 30)}" for _ in range(n)]
        gone = set(rng.sample(range(n), rng.randint(0, n // 4)))
        copy = [w if i not in gone else "zzz" for i, w in enumerate(template) if i not in gone or rng.random() < 0.5]
        doc = [f"d{i}" for i in range(rng.randint(0, 30))] + copy + [f"e{i}" for i in range(rng.randint(0, 30))]
        best = plain_best(template, doc)[1]
        got = licenses.find_licenses(" ".join(doc), licenses.build_index({"x": " ".join(template)}), {})
        assert [m.matched for m in got] == ([best] if best >= licenses.MIN_COVERAGE * n else [])


COMPETING = {name: text for name, text in licenses.TEMPLATES.items() if len(text.split()) <= 250}


def plain_named(text, index):
    """Names of the licenses that whole alignments of all templates find, of those that overlap the one with most words."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    found = []
    for t in index.templates:
        n = len(t.words)
        low, high = [-n] * n, [len(words)] * n
        way = licenses.align_notice(t, words, low, high) if n <= licenses.NOTICE_WORDS else licenses.align_banded(t.words, words, np.array(low), np.array(high))
        if way[0] >= licenses.MIN_COVERAGE * n:
            found.append((-way[0], -way[0] / n, t.name, way[1], way[2]))
    kept = []
    for m in sorted(found):
        if all(m[4] < k[3] or k[4] < m[3] for k in kept):
            kept.append(m)
    return [m[2] for m in sorted(kept, key=lambda m: m[3])]


def test_all_templates_competing_against_whole_alignments():
    rng, index = random.Random(11), licenses.build_index(COMPETING)
    agreed, total = 0, 0
    for _ in range(250):
        name = rng.choice(list(COMPETING))
        words, rate = re.findall(r"[^\W_]+", COMPETING[name]), rng.choice([0, 0.03, 0.08, 0.15])
        copy = []
        for w in words:
            if rng.random() < rate:
                copy += rng.choice([[], ["zzz"], [w, "yyy"], [rng.choice(["MIT", "Affero", "2"])]])
            else:
                copy.append(w)
        text = " ".join([*(f"d{i}x" for i in range(rng.randint(0, 9))), *copy, *(f"e{i}x" for i in range(rng.randint(0, 9)))])
        expected = plain_named(text, index)
        got = [m.license for m in licenses.find_licenses(text, index, {})]
        total += len(expected)
        agreed += sum(n in got for n in expected)
        assert set(got) <= set(expected) or len(got) <= len(expected), text
    assert total > 150
    assert agreed >= 0.98 * total


def test_notices_of_other_licenses_are_not_named():
    for text in (
        "Released under the BSD License", "released under the GPL license", "Licensed under CC BY-NC-ND 4.0", "Licensed under the Apache License, Version 1.1",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ):
        assert named(text) == [], text


def test_long_and_repetitive_texts_take_time_in_proportion():
    def seconds(text):
        began = time.process_time()
        licenses.find_licenses(text, SHORT_INDEX, {})
        return time.process_time() - began

    short, long = (min(seconds("All rights reserved. " * k) for _ in range(3)) for k in (4000, 16_000))
    assert short < 1 and long < 10 * short + 0.2
    assert named("All rights reserved. " * 500) == ["All-rights-reserved"] * 500
    gpl = licenses.TEMPLATES["GPL-3.0-text"]
    assert named(gpl + gpl) == ["GPL-3.0-text"] * 2
    words, rng, snippets = gpl.split(), random.Random(2), []
    while len(snippets) < 40_000:
        at = rng.randrange(len(words))
        snippets += words[at : at + rng.randrange(20, 80)]
    assert seconds(" ".join(snippets)) < 5


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 4))
def test_winnowing_keeps_one_of_each_window(values, window):
    kept = licenses.winnow(np.array(values, np.uint64), window).tolist()
    for i in range(len(values) - window + 1):
        inside = [k for k in kept if i <= k < i + window]
        assert min(values[i : i + window]) in [values[k] for k in inside]


def plain_contamination(pairs, items, n=13):
    def words(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]

    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - n + 1) if len(w) >= n else [0] if w else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    rows = []
    for i, text in pairs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(rows)


def test_contamination_matches_plain_version(spark, docs):
    rng = random.Random(5)
    words = [f"{c}{i}" for c in "aé" for i in range(9)]
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((30, 20, 13, 12, 3, 1, 14))] + [(10, None), (11, " .-"), (12, "A0 a1, É1")]
    items.append((2, items[0][1]))
    pairs = []
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 80))
        at = rng.randint(0, len(w))
        source = rng.choice(items)[1] or ""
        w[at:at] = source.upper().split()[: rng.randint(0, 25)]
        pairs.append((i, rng.choice([" ", "; ", "\n"]).join(w)))
    pairs += [(90, None), (91, ""), (92, "a0 a1 É1 é1 " * 3000), (93, f"{'x' * 70} {items[0][1]}"), (94, f"{items[1][1]};;;{'y' * 99}")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("pos", F.lit(1))
    got = decontam.contamination(docs(*pairs), bench)
    assert out(got) == plain_contamination(pairs, items)
    for way in ({"broadcast_windows": 0}, {"piece_chars": 40}, {"piece_chars": 7, "broadcast_windows": 0}):
        assert out(decontam.contamination(docs(*pairs), bench, **way)) == out(got)
    dirty = {r[0] for r in plain_contamination(pairs, items) if r[5]}
    left = decontam.decontaminate(docs(*pairs), bench)
    assert {r[0] for r in out(left, "doc_id")} == {i for i, _ in pairs} - dirty and left.columns == docs().columns


def test_contamination_of_one_very_long_text(spark, docs):
    """2 million words: the text is read in pieces, and a passage across their border is found in full."""
    item = " ".join(f"q{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    filler = "lorem ipsum, dolor " * 350_000
    d = docs((1, f"{filler}{item} {filler}"), (2, f"{filler[: decontam.PIECE_CHARS]} {item}"))
    assert out(decontam.contamination(d, bench), "doc_id", "n_words", "n_hit", "contaminated") == [
        (1, 2_100_040, 40, False), (2, len(filler[: decontam.PIECE_CHARS].split()) + 40, 40, False),
    ]


def test_contamination_edges(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    d = docs((1, "Alpha, beta gamma! delta"), (1, "clean"), (None, "x alpha beta gamma"), (None, None), (1, "Alpha, beta gamma! delta"))
    assert out(decontam.contamination(d, bench), "doc_id", "n_words", "n_hit") == [(1, 1, 0), (1, 4, 3), (1, 4, 3), (None, 0, 0), (None, 4, 3)]
    assert decontam.contamination(d, bench.where("false")).where("n_hit > 0").count() == 0 and decontam.contamination(docs(), bench).count() == 0
    spans = decontam.decontaminate(d, bench, remove="spans")
    assert out(spans, "doc_id", "text") == [(1, "! delta"), (1, "! delta"), (1, "clean"), (None, "x"), (None, None)]
    with pytest.raises(ValueError):
        decontam.decontaminate(d, bench, remove="lines")


def test_toxicity_learns_and_generalises(spark, docs):
    rng = random.Random(2)
    plain, bad = [f"word{i}" for i in range(200)], ["grubnok", "zlarf", "vromp"]
    pairs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "", "xy", "qu"]))
        pairs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    pairs += [(2000, None), (2001, ""), (2002, "word1 " * 30_000 + "zlarfen"), (None, "zlarf")]
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(*pairs), marks).collect()}
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(900) if got[i].held_out} == set(held)
    assert all(got[i].predicted == dict(labels)[i] for i in held)
    assert got[2000].score == got[2001].score < 0.3 and got[2002].predicted == 1 and got[None].predicted == 1
    left = toxicity.drop_toxic(docs(*pairs), marks)
    assert left.columns == docs().columns and left.where("doc_id % 5 = 0 AND doc_id < 900").count() == 0 and left.where("doc_id % 5 != 0 AND doc_id < 900").count() == 720


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert out(toxicity.toxicity(docs((1, "a"), (2, None)), none), "doc_id", "predicted") == [(1, 0), (2, 0)]
    assert toxicity.toxicity(docs(), none).count() == 0
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert out(toxicity.toxicity(docs((1, "a")), ones), "predicted") == [(1,)]


def random_machine(rng, n=12):
    model = toxicity.FactorizationMachine.fresh(np.arange(n), 0.3)
    model.linear = rng.normal(0, 1, n + 1)
    model.factors = rng.normal(0, 1, model.factors.shape)
    rows = toxicity.Rows.of([np.array([0, *sorted(rng.choice(n, rng.integers(0, 8), replace=False) + 1)]) for _ in range(20)])
    return model, rows


def test_logits_are_the_sum_over_pairs():
    model, rows = random_machine(np.random.default_rng(0))
    texts = np.split(rows.flat, rows.starts[1:])
    plain = [sum(model.linear[t]) + sum(model.factors[a] @ model.factors[b] for i, a in enumerate(t) for b in t[:i]) for t in texts]
    assert np.allclose(model.logits(rows), plain)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model, rows = random_machine(rng)
    labels = rng.integers(0, 2, 20).astype(float)

    def loss():
        p = model.scores(rows)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for values, grad in zip((model.linear, model.factors), model.gradients(rows, labels), strict=True):
        for at in np.ndindex(*values.shape):
            kept = values[at]
            values[at] = kept + 1e-5
            up = loss()
            values[at] = kept - 1e-5
            numeric, values[at] = (up - loss()) / 2e-5, kept
            assert abs(numeric - grad[at]) < 1e-6


def hashed(texts):
    return toxicity.Rows.of([np.array([toxicity.CONSTANT, *sorted({b for w in toxicity._distinct_words(t) for b in toxicity._buckets(w)})]) for t in texts])


def test_learns_what_only_pairs_tell():
    """Toxic is insult with groupx and calm with plainx; no word tells anything by itself."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = rng.choices([f"word{i}" for i in range(200)], k=25) + ["insult" if a else "calm", "groupx" if b else "plainx"]
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(float(a == b))
    labels, held = np.array(labels), np.arange(2400) % 4 == 2
    seen = hashed(np.array(texts)[~held])
    model = toxicity.machine(seen, labels[~held])
    rows = toxicity.Rows.of([model.reader()(t) for t in np.array(texts)[held]])
    assert ((model.scores(rows) >= 0.5) == labels[held]).mean() > 0.95
    every = np.setdiff1d(seen.flat, toxicity.CONSTANT)
    linear = toxicity.FactorizationMachine.fresh(every, 0.5)
    linear.factors[:] = 0
    linear.learn(seen.within(every), labels[~held], 400, 128)
    rows = toxicity.Rows.of([linear.reader()(t) for t in np.array(texts)[held]])
    assert abs(((linear.scores(rows) >= 0.5) == labels[held]).mean() - 0.5) < 0.1


def test_weighs_what_speaks_against_the_label():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["zlarf", "kindly"] if i % 3 else ["zlarf", "vromp"], k=6) + rng.choices([f"w{j}" for j in range(50)], k=9)) for i in range(600)]
    model = toxicity.machine(hashed(texts), np.array([float(i % 3 == 0) for i in range(600)]))
    places = model.reader()("kindly")[1:]
    assert len(places) and (model.linear[places] < 0).all()


def test_toxicity_of_labels_beyond_the_sample(spark, docs):
    rng = random.Random(6)
    pairs = [(i, " ".join(rng.choices(["a", "b", "c"], k=5) + ["zlarf"] * (i % 4 == 0))) for i in range(800)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(docs(*pairs), marks, training_rows=200)
    assert {r.doc_id for r in toxicity.score(docs(*pairs), model).where("score >= 0.3").collect()} == {i for i in range(0, 800, 4)}


def test_a_prompt_that_all_items_share_costs_a_number_a_hit(spark, docs):
    prompt = " ".join(f"p{i}" for i in range(20))
    items = [(i, f"{prompt} own{i} words{i}") for i in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(i, f"before {prompt} after") for i in range(20)]
    hits, sets = decontam._hits(docs(*pairs), bench)
    assert hits.count() == 160 and dict(hits.dtypes)["item_set"] == "bigint"
    assert hits.select("item_set").distinct().count() == 1 and sets.count() == 301
    assert out(decontam.contamination(docs(*pairs), bench)) == plain_contamination(pairs, items)
    assert {len(r["items"]) for r in decontam.find_hits(docs(*pairs[:1]), bench).collect()} == {300}
