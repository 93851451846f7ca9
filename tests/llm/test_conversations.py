"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_report(rows):
    """rows: (conv_id, turn, role, text) of one table; a report for each conv_id."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
            kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, lines = plain_edits([(r, x, f) for (_, r, x), f in zip(kept, faults, strict=True)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def plain_edits(rows):
    """(cost, audit, lines) of the cheapest edits, ASCII-least, over the grammar's states, with whole audits compared."""
    n = len(rows)

    @functools.cache
    def best(i, state, inserted):
        """state: what the roles so far end with; inserted: letters inserted in a row, at most two are of use."""
        options = []
        if i == n and state in ("", "a"):
            options.append((0, "", ()))
        moves = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 2:
            for letter in moves.replace("s", ""):
                cost, audit, lines = best(i, letter, inserted + 1)
                role = {"u": "user", "a": "assistant"}[letter]
                options.append((cost + 2, "I" + audit, (f"{role}:", lines)))
        if i < n:
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, lines))
            if fault in ("", "truncated"):
                for letter in moves:
                    cost, audit, lines = best(i + 1, letter, 0)
                    cost += fault == "truncated"
                    if role[:1] == letter:
                        options.append((cost, "K" + audit, (f"{role}:{text}", lines)))
                    if letter != "s":
                        name = {"u": "user", "a": "assistant"}[letter]
                        options.append((cost + 2, "R" + audit, (f"{name}:{text}", lines)))
        return min(options, key=lambda x: x[:2], default=(10**9, "", ()))

    for i in range(n, -1, -1):
        best(i, "", 0)
    cost, audit, chain = best(0, "", 0)
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    return cost, audit, lines


def random_conversation(rng, conv, n, turns=None):
    rows = []
    for k in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "users"])
        if rng.random() < 0.6:
            role = ["user", "assistant"][k % 2]
        text = rng.choice(["Yes.", "No!", "Why?", "and so", " ", "", None, f"Turn {k}.", f"turn {k}", "x.\n", " "])
        turn = k + rng.choice([0, 0, 0, 0, 3]) if turns is None else rng.choice(turns)
        rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
    return rows


@pytest.fixture
def table(spark):
    def make(rows):
        schema = "conv_id long, turn long, role string, text string, copies string, new string, part string, cost string"
        return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(3)

    return make


def report(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        rows += random_conversation(rng, conv, rng.randrange(1, 12))
    rows += random_conversation(rng, None, 9)
    rows += random_conversation(rng, 200, 90)
    rows += random_conversation(rng, 201, 40, turns=[None])
    rows += [(202, 5, "user", "Again.")] * 70 + [(202, 6, "user", "Again.")] * 3 + [(202, 7, "assistant", " ")] * 5
    return rows


def test_reports_equal_plain_search(table):
    rows = sample(1)
    assert report(conversations.repair_report(table(rows))) == plain_report(rows)


def test_pieces_of_any_size_give_the_same(table, monkeypatch, spark):
    rows = sample(2)
    expected = plain_report(rows)
    # One turn a piece: conversations are put together from pieces that lie in several partitions.
    for turns in (1, 3):
        monkeypatch.setattr(conversations, "PIECE_TURNS", turns)
        assert report(conversations.repair_report(table(rows))) == expected
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert report(conversations.repair_report(table(rows))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_alignment_equals_plain_search():
    rng = random.Random(5)
    for _ in range(400):
        rows, turns = [], []
        for _ in range(rng.randrange(0, 9)):
            role, fault = rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["", "", "truncated", "blank"])
            rows.append((role, "t", fault))
            turns.append(conversations.Turn(role[:1], fault != "blank", int(fault == "truncated"), int(fault == "blank")))
        cost, audit, _ = plain_edits(rows)
        ((end, (got, edits)),) = conversations.ways(turns, conversations.START, conversations._END_COSTS).items()
        missing = conversations._MISSING[end]
        assert (got + 2 * missing, edits + "I" * missing) == (cost, audit)


def test_band_leaves_out_only_what_costs_more():
    turns = [conversations.Turn(x, True, 0, 0) for x in "uaauuausua"]
    for target in ("", "ua", "uauaua", "suauauaua", "uauauauaua"):
        cost, edits = conversations.align(turns, target, 10**6)
        assert conversations.align(turns, target, cost) == (cost, edits)
        assert conversations.align(turns, target, cost - 1) is None


def test_repaired_turns_and_empty_tables(table):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", " ")]
    got = [(r.place, r.edit, r.role, r.text) for r in conversations.repair(table(rows)).orderBy("place").collect()]
    assert got == [(0, "K", "system", "Be brief."), (1, "I", "user", ""), (2, "K", "assistant", "Hello."), (3, "K", "user", "Hi!"), (4, "I", "assistant", "")]
    empty = table(rows).where(F.lit(False))
    assert conversations.repair(empty).count() == conversations.repair_report(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(conversations.repair_report(table([(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
