"""License scanning: winnowed fingerprints pick candidates, alignment in a band around their chains measures them."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by which public licenses are applied.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: More notices, of which many differ from one above in a few words; of both the one with more words matched is reported.
TEMPLATES |= {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Affero General"),
    "All-rights-reserved": "All rights reserved",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
    "LGPL-2.1-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"),
}
#: Whole texts, named by their files with "-text" added.
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Words that name a license or a variant of one; so do numbers, which stand for versions.
NAMING = frozenset(
    "academic affero agpl apache apsl artistic attribution boost bsd bsl by cc cc0 cddl cecill commons commercial cpl creative "
    "derivatives eclipse epl eupl gfdl gnu gpl isc lesser lgpl library mit modified mozilla mpl mspl ms nc ncsa nd noassertion "
    "nocommercial noderivatives noderivs noncommercial ofl openssl php postgresql proprietary psf public python ruby sa sharealike "
    "simplified unlicense vim wtfpl w3c x11 zlib zpl".split()
)
#: Most words of a notice, whose naming words must be met, and no others come between.
NOTICE_WORDS = 60
#: Most words of a fingerprint, and fingerprints of which one is kept.
GRAM, WINDOW = 3, 4
#: Places to either side of a chain's diagonals that are aligned, at most.
BAND = 6
MIN_COVERAGE = 0.8
#: Stretches of hits before a stretch that a chain may go on from.
LOOK_BACK = 24
#: Most words of all templates together; the index goes to every task.
INDEX_WORDS = 1_000_000
_MEMO = 200_000
_WORD = re.compile(r"[^\W_]+")


class Match(NamedTuple):
    license: str
    start: int
    end: int
    matched: int
    words: int


class Template(NamedTuple):
    """A template's words, by number and as text; naming: places of words that tell it from other licenses, if it is a notice."""

    name: str
    words: list[str]
    naming: frozenset[int]
    least: int

    @property
    def band(self) -> int:
        """Narrow for short notices, so that one does not reach into the next."""
        return min(BAND, max(1, len(self.words) // 3))


class Index(NamedTuple):
    """Templates, and for each (words of a fingerprint, window) an inverted index: fingerprints, sorted, each with template and place."""

    templates: list[Template]
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    hashes = []
    for word in words:
        h = memo.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode(errors="surrogatepass"))
            if len(memo) < _MEMO:
                memo[word] = h
        hashes.append(h)
    return np.array(hashes, np.uint64)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints that are kept: the least of each window, the last of equal ones.

    Equal stretches of `window` fingerprints in two texts keep the same one, so a text and a template share a kept
    fingerprint wherever that many in a row are equal. Fewer than `window` are one window.
    """
    if not len(grams) or window == 1:
        return np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
    last = windows.shape[1] - 1 - windows[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(windows)) + last)


def _spare(n: int, min_coverage: float) -> int:
    """Words of n that a match may lack."""
    return n - min(n, max(1, math.ceil(min_coverage * n)))


def _shape(n: int, min_coverage: float) -> tuple[int, int]:
    """Words of a fingerprint, and of a window: together no more than words that stay in a row, whichever a match lacks."""
    spare = _spare(n, min_coverage)
    row = -(-(n - spare) // (spare + 1))
    size = max(1, min(GRAM, row))
    return size, max(1, min(WINDOW, row - size + 1))


def build_index(templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> Index:
    """The winnowed fingerprints of all templates. Templates of fewer than three words are left out."""
    kept, entries = [], defaultdict(list)
    total = 0
    for name, text in templates.items():
        words = _WORD.findall(text.lower())
        total += len(words)
        if len(words) < GRAM:
            continue
        size, window = _shape(len(words), min_coverage)
        grams = _grams(_hashes(words, {}), size)
        places = winnow(grams, window)
        naming = frozenset(i for i, w in enumerate(words) if _names(w)) if len(words) <= NOTICE_WORDS else frozenset()
        entries[size, window].append((grams[places], np.full(len(places), len(kept)), places))
        kept.append(Template(name, words, naming, max(1, len(places) // 10) if len(places) >= 40 else 1))
    if total > INDEX_WORDS:
        raise ValueError(f"the templates have over {INDEX_WORDS} words")
    index = {}
    for shape, parts in entries.items():
        grams, owners, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(grams, kind="stable")
        index[shape] = (grams[by], owners[by], places[by])
    return Index(kept, index)


def _names(word: str) -> bool:
    return word in NAMING or word.isdigit()


class _Stretch(NamedTuple):
    """Hits of a template on one diagonal (place in the text less place in the template), close to each other."""

    first: int
    last: int
    diagonal: int
    hits: int


def _stretches(owner: np.ndarray, at: np.ndarray, diagonal: np.ndarray) -> dict[int, list[_Stretch]]:
    """By template its stretches, in order of the text."""
    if not len(owner):
        return {}
    order = np.lexsort((at, diagonal, owner))
    owner, at, diagonal = owner[order], at[order], diagonal[order]
    new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) > 4 * WINDOW)])
    last = np.append(new[1:], len(at)) - 1
    out = defaultdict(list)
    for k, f, e, d, n in zip(*(x.tolist() for x in (owner[new], at[new], at[last], diagonal[new], last - new + 1)), strict=True):
        out[k].append(_Stretch(f, e, d, n))
    for found in out.values():
        found.sort()
    return out


def chains(found: Sequence[_Stretch], template: Template) -> Iterator[list[_Stretch]]:
    """Stretches that go on from each other in text and template, most hits first; each stretch in one chain.

    A stretch goes on from one of the LOOK_BACK before it, whose place in the template is earlier too, and whose diagonal
    differs by no more than the band and half of what lies between.
    """
    n, band = len(template.words), template.band
    score, back = [s.hits for s in found], [-1] * len(found)
    for i, s in enumerate(found):
        for j in range(i - 1, max(-1, i - 1 - LOOK_BACK), -1):
            b = found[j]
            gap = s.first - b.last
            if gap <= 0 or gap > n or s.first - s.diagonal <= b.last - b.diagonal:
                continue
            drift = abs(s.diagonal - b.diagonal)
            if drift <= band + gap // 2 and score[j] + s.hits - drift / 8 > score[i]:
                score[i], back[i] = score[j] + s.hits - drift / 8, j
    used = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (-score[i], i)):
        chain, k = [], i
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(found[k])
            k = back[k]
        if sum(s.hits for s in chain) >= template.least:
            yield chain[::-1]


def _band(chain: Sequence[_Stretch], n: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest diagonal for each place of the template: those of the chain there, and the band beside them."""
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    before, at = chain[0], 0
    for s in (*chain, None):
        to = n if s is None else max(at, s.first - s.diagonal)
        after = before if s is None else s
        low[at:to], high[at:to] = min(before.diagonal, after.diagonal) - band, max(before.diagonal, after.diagonal) + band
        before, at = after, to
    return low, high


def align(template: list[str], words: list[str], diagonal: int = 0, band: int | None = BAND) -> tuple[int, int, int]:
    """align_banded around one diagonal; band None tries all places."""
    low, high = (-len(template), len(words)) if band is None else (diagonal - band, diagonal + band)
    return align_banded(template, words, np.full(len(template), low), np.full(len(template), high))


def align_banded(template: list[str], words: list[str], low: np.ndarray, high: np.ndarray) -> tuple[int, int, int]:
    """(matched, first, last): words that the best local alignment matches, and the document's words it spans.

    Only places whose diagonal (place in the document less place in the template) lies in the band of the template's
    place are tried. Matches score 2, other words and gaps -1.
    """
    n, m = len(template), len(words)
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    have = np.array([codes.get(w, -1) for w in words], np.int64)
    # A cell is score, matched and first in one number; 0 is no alignment.
    bits = m.bit_length()
    one = 1 << bits
    point = one << (n.bit_length() + 1)
    best, found = 0, (0, 0, 0)
    row, now = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)  # place in the document + 1
    at = np.arange(m, dtype=np.int64)
    steps = at * point
    row_used, now_used = slice(0, 0), slice(0, 0)
    for i, (want, lo, hi) in enumerate(zip(template, low.tolist(), high.tolist(), strict=True)):
        lo, hi = max(0, i + lo), min(m, i + hi + 1)
        now[now_used] = 0
        if lo < hi:
            hit = have[lo:hi] == codes[want]
            before = row[lo:hi]
            cell = np.where(before > 0, before, at[lo:hi]) + np.where(hit, 2 * point + one, -point)
            cell = np.maximum(cell, row[lo + 1 : hi + 1] - point)
            cell = np.maximum.accumulate(cell + steps[: hi - lo]) - steps[: hi - lo]
            cell[cell < point] = 0
            now[lo + 1 : hi + 1] = cell
            now_used = slice(lo + 1, hi + 1)
            if hit.any():
                key = np.where(hit, cell >> bits, 0)
                j = int(key.argmax())
                if key[j] > best:
                    best, whole = int(key[j]), int(cell[j])
                    found = ((whole % point) >> bits, whole % one, lo + j)
        row, now, row_used, now_used = now, row, now_used, row_used
    return found


def align_notice(template: Template, words: Sequence[str], low: Sequence[int], high: Sequence[int]) -> tuple[int, int, int]:
    """As align_banded, with the words looked at: no match (0, 0, 0) lacks a naming word, or has another one in between."""
    rows: list[dict[int, tuple[int, int, int, str]]] = []
    top, before = (0, 0, 0, 0), {}
    for i, want in enumerate(template.words):
        row = {}
        for j in range(max(0, i + low[i]), min(len(words), i + high[i] + 1)):
            hit = words[j] == want
            old = before.get(j - 1)
            options = [(old[0], old[1], old[2], "m") if old else (0, 0, -j, "m")]
            score, matched, first, _ = options[0]
            cell = (score + 2, matched + 1, first, "m") if hit else (score - 1, matched, first, "m")
            for old, move in ((before.get(j), "t"), (row.get(j - 1), "d")):
                if old and (old[0] - 1, old[1], old[2]) > cell[:3]:
                    cell = (old[0] - 1, old[1], old[2], move)
            if cell[0] > 0:
                row[j] = cell
                if hit and cell[:2] > top[:2]:
                    top = (cell[0], cell[1], i, j)
        rows.append(row)
        before = row
    score, matched, i, last = top
    if not score:
        return 0, 0, 0
    j, met, others = last, set(), []
    while i >= 0 and j >= 0 and j in rows[i]:
        move = rows[i][j][3]
        if move == "m" and words[j] == template.words[i]:
            met.add(i)
        elif move != "t":
            others.append(words[j])
        first = j
        i, j = i - (move != "d"), j - (move != "t")
    if template.naming - met or any(map(_names, others)):
        return 0, 0, 0
    return matched, first, last


def _measured(template: Template, words: list[str], chain: Sequence[_Stretch], needed: int, memo: dict) -> tuple[int, int, int]:
    """The best alignment in the band around a chain: matched, first and last word."""
    n, band = len(template.words), template.band
    start = chain[0].diagonal
    if all(s.diagonal == start for s in chain) and start >= 0 and words[start : start + n] == template.words:
        return n, start, start + n - 1
    low, high = _band(chain, n, band)
    lo, hi = max(0, int(low.min())), min(len(words), n + int(high.max()) + 1)
    region = words[lo:hi]
    # In any order: words of the template that the region has, each as often as it has it.
    if (Counter(template.words) & Counter(region)).total() < needed:
        return 0, 0, 0
    if not template.naming <= {i for i, w in enumerate(template.words) if w in set(region)}:
        return 0, 0, 0
    if n > NOTICE_WORDS:
        matched, first, last = align_banded(template.words, region, low - lo, high - lo)
    else:
        # Repeated lines are common, and so are notices with the same words around them.
        key = (template.name, tuple(region), low[0] - lo, tuple(s.diagonal - lo for s in chain), tuple(s.first - lo for s in chain))
        if key not in memo:
            if len(memo) >= _MEMO:
                memo.clear()
            memo[key] = align_notice(template, region, (low - lo).tolist(), (high - lo).tolist())
        matched, first, last = memo[key]
    return matched, lo + first, lo + last


def find_licenses(text: str, index: Index, memo: dict[str, int], min_coverage: float = MIN_COVERAGE, seen: dict | None = None) -> list[Match]:
    """Matches by start; of those that overlap, the one with most matched words, then the best covered, then by name.

    memo, seen: what was worked out before, of words and of short stretches.
    """
    if not text or not index.grams:
        return []
    seen = {} if seen is None else seen
    found = list(_WORD.finditer(text))
    words = [m[0].lower() for m in found]
    h = _hashes(words, memo)
    matches = []
    for (size, window), (grams, owners, places) in index.grams.items():
        own = _grams(h, size)
        kept = winnow(own, window)
        own = own[kept]
        start, stop = np.searchsorted(grams, own), np.searchsorted(grams, own, "right")
        hits = np.flatnonzero(stop > start)
        if not len(hits):
            continue
        counts = (stop - start)[hits]
        at = np.repeat(kept[hits], counts)
        entry = np.repeat(start[hits], counts) + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = owners[entry]
        enough = np.bincount(owner, minlength=len(index.templates)) >= [t.least for t in index.templates]
        some = enough[owner]
        for k, stretches in _stretches(owner[some], at[some], (at - places[entry])[some]).items():
            template = index.templates[k]
            n = len(template.words)
            needed = math.ceil(min_coverage * n)
            for chain in chains(stretches, template):
                matched, first, last = _measured(template, words, chain, needed, seen)
                if matched >= needed:
                    matches.append(Match(template.name, found[first].start(), found[last].end(), matched, n))
    matches = sorted(set(matches), key=lambda m: (-m.matched, -m.matched / m.words, m.license, m.start))
    taken: list[Match] = []
    starts: list[int] = []
    for m in matches:
        i = bisect.bisect_left(starts, m.end)
        if not i or taken[i - 1].end <= m.start:
            at = bisect.bisect_left(starts, m.start)
            starts.insert(at, m.start)
            taken.insert(at, m)
    return taken


_SPAN = "struct<license: string, start: bigint, end: bigint, matched: bigint, words: bigint>"


def license_spans(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """(id, spans array<struct<license, start, end, matched, words>>) for each row of docs.

    Words are letters and digits in lower case. Winnowed fingerprints of up to three words are looked up in an inverted
    index of all templates; hits that go on from each other are chained, and the best local alignment in a band around
    a chain is reported when at least min_coverage of the template's words match. A notice's naming words (NAMING, and
    numbers) must all match, and none may stand between, so that no license is named by another's notice. Spans are
    code points, ends exclusive. Templates of fewer than three words are never found. Ties: see find_licenses.

    Null and empty texts have no spans; null and repeated ids are rows like any other; an empty table or no
    templates give no spans. Other columns are ignored. No shuffle; the index goes with the tasks, and is
    bounded by INDEX_WORDS.
    """
    index = build_index(TEMPLATES if templates is None else templates, min_coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), *((n, pa.int64()) for n in ("start", "end", "matched", "words"))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        seen: dict = {}
        for batch in batches:
            spans = [[m._asdict() for m in find_licenses(t or "", index, memo, min_coverage, seen)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "spans": pa.array(spans, kind)})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, spans array<{_SPAN}>")
    return out.withColumnRenamed("id", id_col)


def license_report(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_licenses, licenses, coverage, spans): names and spans comma-joined by start, the best coverage or null.

    One row for each row of docs: null and empty texts have no licenses, repeated rows are rows of their own, ties go as
    in find_licenses, an empty table gives no rows, further columns are ignored.
    """
    found = license_spans(docs, templates, id_col, text_col)
    told = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"], s["matched"], s["words"]))
    return found.select(
        id_col,
        F.size("spans").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("spans.license"))), ",").alias("licenses"),
        F.array_max(F.transform("spans", lambda s: s["matched"] / s["words"])).alias("coverage"),
        F.array_join(told, ",").alias("spans"),
    )
