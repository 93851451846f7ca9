"""Repair of conversations: cheapest edits that make turns alternate, by alignment with the strings of a grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.common import SPACES, written

#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Ends of sentences, and pairs of adjacent role initials that are in order.
ENDS = ".!?"
IN_ORDER = ("su", "ua", "au")
#: Most turns, and characters, of a piece of a conversation that is aligned at once.
PIECE_TURNS, PIECE_CHARS = 32, 1_000_000

# The grammar (s?(ua)+)? read letter by letter: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Turns that a conversation that ends in a state still needs.
_MISSING = (0, 2, 1, 0)
_ROLE = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Turn:
    """A turn as alignment sees it: its role's initial, what keeping it adds, and how many deletions are forced.

    free: it may be kept; then the forced deletions (of its repeats) come after it.
    """

    initial: str
    free: bool
    added: int
    forced: int


def align(turns: Sequence[Turn], target: str, bound: int) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest edits of turns whose role initials are the target, if they cost at most the bound.

    Edits are initials of keep, rerole, delete and insert; among the cheapest the ASCII-least. Nothing is inserted after
    the last turn. Wagner-Fischer from the last turn and letter to the first, in an Ukkonen band: cells through which no
    edits within the bound go, as each step off the diagonal costs an insertion or a deletion, are left out.
    """
    free = sum(t.free for t in turns)
    base = DELETE * sum(t.forced for t in turns)
    bound -= base
    off, far = len(target) - free, bound + 1

    def least(d: int) -> int:
        return INSERT * max(0, d) + DELETE * max(0, -d)

    band = [d for d in range(-free, len(target) + 1) if least(d) + least(off - d) <= bound]
    if not band:
        return None
    low, high = band[0], band[-1]
    cells = [{} for _ in turns] + [{len(target): 0}]
    done = free
    for i in range(len(turns) - 1, -1, -1):
        turn, after, here = turns[i], cells[i + 1], cells[i]
        done -= turn.free
        delete = DELETE if turn.free else 0
        for j in range(min(len(target), done + high), max(0, done + low) - 1, -1):
            cost = after.get(j, far) + delete
            cost = min(cost, here.get(j + 1, far) + INSERT)
            if turn.free and j < len(target):
                cost = min(cost, after.get(j + 1, far) + _fit(turn, target[j], far))
            if cost <= bound:
                here[j] = cost
    cost = cells[0].get(0)
    if cost is None:
        return None
    edits, i, j = [], 0, 0
    while i < len(turns):
        turn, now, after = turns[i], cells[i][j], cells[i + 1]
        if now == after.get(j, far) + (DELETE if turn.free else 0):
            edits.append("D" * (turn.free + turn.forced))
            i += 1
        elif now == cells[i].get(j + 1, far) + INSERT:
            edits.append("I")
            j += 1
        else:
            edits.append(("K" if turn.initial == target[j] else "R") + "D" * turn.forced)
            i, j = i + 1, j + 1
    return cost + base, "".join(edits)


def _fit(turn: Turn, letter: str, far: int) -> int:
    """What a turn costs in the place of a letter. No turn is made a system turn."""
    return turn.added if turn.initial == letter else turn.added + REROLE if letter != "s" else far


def _targets(state: int, length: int) -> Iterator[tuple[str, int]]:
    """Strings of the grammar from a state on, of a length, with the state where they end."""
    if not length:
        yield "", state
        return
    for letter, then in _NEXT[state].items():
        rest, end = "", then
        while len(rest) < length - 1:
            (more, end), *_ = _NEXT[end].items()
            rest += more
        yield letter + rest, end


def ways(turns: Sequence[Turn], state: int, after: Sequence[int] | None = None) -> dict[int, tuple[int, str]]:
    """By end state the cheapest (cost, edits) of turns that start in a state; among the cheapest the ASCII-least.

    Each feasible length of the grammar's string is aligned, from that of the free turns outwards, until insertions or
    deletions alone cost more than the cheapest edits so far. after: what each end state still costs; then only the
    best of all end states is found.
    """
    free = sum(t.free for t in turns)
    base = DELETE * sum(t.forced for t in turns)
    if not turns:
        return {state: (0, "")}
    best: dict[int, tuple[int, str, int]] = {}
    step, any_left = 0, True
    while any_left:
        any_left = step == 0
        for length in sorted({free - step, free + step} - {-1}):
            for target, end in _targets(state, length) if length >= 0 else ():
                rival, more = (end, 0) if after is None else (None, after[end])
                # To delete all and insert all is an alignment with any target.
                incumbent = best[rival][0] if rival in best else base + DELETE * free + INSERT * length + more
                if base + (INSERT * step if length > free else DELETE * step) + more > incumbent:
                    continue
                any_left = True
                found = align(turns, target, incumbent - more)
                if found is not None:
                    new = (found[0] + more, found[1], end)
                    best[rival] = min(best.get(rival, new), new)
        step += 1
    return {end: (cost - (after[end] if after else 0), edits) for cost, edits, end in best.values()}


@dataclass
class _Row:
    turn: int | None
    role: str
    text: str
    copies: int
    new: bool

    def faults(self) -> tuple[int, int, int]:
        """Blank, duplicate and truncated among the copies."""
        bare = self.text.strip(SPACES)
        if not bare:
            return self.copies, 0, 0
        return 0, self.copies - self.new, int(self.new and bare[-1] not in ENDS)

    def seen(self) -> Turn:
        blank, duplicate, cut = self.faults()
        free = not blank and self.new
        return Turn(self.role[:1], free, CUT * cut, self.copies - free)


@dataclass
class _Counts:
    """Counts of a stretch of a conversation; two stretches add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    @classmethod
    def of(cls, row: _Row) -> _Counts:
        initial = row.role[:1]
        return cls(*row.faults(), row.copies - 1, int(row.turn is not None), row.turn, row.turn, initial, initial)

    def add(self, other: _Counts) -> None:
        """Stretches come in order, so that a turn is counted twice only where they meet."""
        if other.first is None:
            return
        if self.first is not None:
            self.illegal += self.last + other.first not in IN_ORDER
        else:
            self.first = other.first
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.low is not None:
            self.turns -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        self.last = other.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]
#: A piece of a conversation: its place, counts, turns, and the cost and edits from each state to each.
_PIECE = f"part int, seq long, {_COUNTS}, roles array<string>, texts array<string>, copies array<long>, news array<boolean>, costs array<long>, audits array<string>"
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_REPORT = "gaps long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text string"
_NAMES = {_REPORT: [c.split()[0] for c in _REPORT.split(", ")], _TURNS: [c.split()[0] for c in _TURNS.split(", ")]}


class _Repair:
    """Follows the pieces of a conversation, and gives what is kept of it."""

    def __init__(self, conv, output: str):
        self.conv, self.output = conv, output
        self.state, self.cost, self.audits, self.counts, self.sha, self.place = START, 0, [], _Counts(), hashlib.sha256(), 0

    def _give(self, edit: str, role: str, text: str) -> Iterator[tuple]:
        if self.output == _REPORT:
            self.sha.update(f"{chr(10) if self.place else ''}{role}:{text}".encode(errors="replace"))
        else:
            yield (self.conv, self.place, edit, role, text)
        self.place += 1

    def _made(self, edit: str, text: str) -> Iterator[tuple]:
        """A turn in a role that the grammar asks for."""
        letter = "a" if self.state == USER else "u"
        self.state = _NEXT[self.state][letter]
        yield from self._give(edit, _ROLE[letter], text)

    def piece(self, rows: Sequence[_Row], counts: _Counts, cost: int, edits: str) -> Iterator[tuple]:
        self.counts.add(counts)
        self.cost += cost
        if self.output == _REPORT:
            self.audits.append(edits)
        at = 0
        for row in rows:
            while edits[at] == "I":
                yield from self._made("I", "")
                at += 1
            turn, edit = row.seen(), edits[at]
            if turn.free and edit == "K":
                self.state = _NEXT[self.state][turn.initial]
                yield from self._give("K", row.role, row.text)
            elif turn.free and edit == "R":
                yield from self._made("R", row.text)
            at += turn.free + turn.forced

    def end(self) -> Iterator[tuple]:
        for _ in range(_MISSING[self.state]):
            self.audits.append("I")
            self.cost += INSERT
            yield from self._made("I", "")
        if self.output == _REPORT:
            c = self.counts
            yield (self.conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, self.cost, "".join(self.audits), self.sha.hexdigest())


def _choice(costs: Sequence[int | None], audits: Sequence[str | None], state: int, after: Sequence[int]) -> tuple[int, str]:
    """The cost and edits of a piece entered in a state, given what each end state still costs."""
    ends = [(costs[4 * state + q] + after[q], audits[4 * state + q], costs[4 * state + q]) for q in range(4) if costs[4 * state + q] is not None]
    _, edits, cost = min(ends)
    return cost, edits


_END_COSTS = [INSERT * n for n in _MISSING]


class _Buffer:
    """Rows that become batches of a schema."""

    def __init__(self, names: Sequence[str], schema: pa.Schema):
        self.names, self.schema, self.rows, self.size = names, schema, [], 0

    def add(self, row: dict, size: int) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.size >= 4 * PIECE_CHARS

    def batch(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.size = [], 0
        return batch


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _pieces(output: str, schema: pa.Schema, most_turns: int):
    """Sorted turns to what is kept of conversations that lie whole in one piece, and to the pieces of others."""
    names = _NAMES[output]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, part = _Buffer(schema.names, schema), TaskContext.get().partitionId()
        rows: list[_Row] = []
        conv, size, seq, began, surely_first = None, 0, 0, False, False

        def give(last: bool) -> None:
            """The rows at hand. last: the conversation surely ends with them."""
            nonlocal seq
            counts = _Counts()
            for row in rows:
                counts.add(_Counts.of(row))
            turns = [row.seen() for row in rows]
            if last and surely_first and not seq:
                repair = _Repair(conv, output)
                (cost, edits), = ways(turns, START, _END_COSTS).values()
                for found in (*repair.piece(rows, counts, cost, edits), *repair.end()):
                    buffer.add(dict(zip(["conv_id", *names], found, strict=True)), sum(len(x) for x in found if isinstance(x, str)))
                return
            costs, audits = [None] * 16, [None] * 16
            for state in (START,) if surely_first and not seq else range(4):
                for end, (cost, edits) in ways(turns, state).items():
                    costs[4 * state + end], audits[4 * state + end] = cost, edits
            values = (
                part, seq, *(getattr(counts, n) for n in _COUNT_NAMES), [r.role for r in rows], [r.text for r in rows],
                [r.copies for r in rows], [r.new for r in rows], costs, audits,
            )
            buffer.add({"conv_id": conv} | dict(zip(_PIECE_NAMES, values, strict=True)), size)
            seq += 1

        for batch in batches:
            for values in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "new")), strict=True):
                if began and values[0] != conv:
                    give(True)
                    rows, size, seq, surely_first = [], 0, 0, True
                elif len(rows) >= most_turns or size >= PIECE_CHARS:
                    give(False)
                    rows, size = [], 0
                conv, began = values[0], True
                rows.append(_Row(*values[1:]))
                size += len(values[3])
                if buffer.full():
                    yield buffer.batch()
        if began:
            give(False)
        yield buffer.batch()

    return cut


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, each conversation's last first, to what each end state of a piece still costs."""
    conv, after = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if after is None or row["conv_id"] != conv:
                conv, after = row["conv_id"], _END_COSTS
            rows.append({"conv_id": conv, "part": row["part"], "seq": row["seq"], "after": after})
            costs = row["costs"]
            ends = [[costs[4 * p + q] + after[q] for q in range(4) if costs[4 * p + q] is not None] for p in range(4)]
            far = max(after) + 1
            after = [min(e, default=far) for e in ends]
        if rows:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int64()), ("after", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)


def _joined(output: str, schema: pa.Schema):
    """Pieces in order, each after a row with its `after`, to what is kept of their conversations."""
    names = ["conv_id", *_NAMES[output]]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, repair, after = _Buffer(schema.names, schema), None, None

        def add(found: Iterator[tuple]) -> None:
            for x in found:
                buffer.add(dict(zip(names, x, strict=True)), sum(len(v) for v in x if isinstance(v, str)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["after"] is not None:
                    after = row["after"]
                    continue
                if repair is None or repair.conv != row["conv_id"]:
                    if repair is not None:
                        add(repair.end())
                    repair = _Repair(row["conv_id"], output)
                cost, edits = _choice(row["costs"], row["audits"], repair.state, after)
                turns = [_Row(None, *x) for x in zip(row["roles"], row["texts"], row["copies"], row["news"], strict=True)]
                add(repair.piece(turns, _Counts(*(row[n] for n in _COUNT_NAMES)), cost, edits))
                if buffer.full():
                    yield buffer.batch()
        if repair is not None:
            add(repair.end())
        yield buffer.batch()

    return follow


def _repaired(turns: DataFrame, output: str) -> DataFrame:
    """turns (conv_id, turn, role, text, copies), no role and no text null, to conv_id and the columns of output."""
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    whole = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    digest = F.sha2("text", 256)
    firsts = whole.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("k"))
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), F.col("k.turn").alias("f_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (digest == F.col("f_digest"))
    marked = whole.join(firsts, same).select("conv_id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("f_turn")).alias("new"))
    ordered = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {conv_type}, {output}, {_PIECE}"
    found = written(ordered.mapInArrow(_pieces(output, _arrow(schema), PIECE_TURNS), schema))
    done = found.where("part IS NULL").select("conv_id", *_NAMES[output])
    pieces = found.where("part IS NOT NULL").select("conv_id", *_PIECE_NAMES)
    last_first = pieces.select("conv_id", "part", "seq", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    after = last_first.mapInArrow(_costs_after, f"conv_id {conv_type}, part int, seq long, after array<long>")
    both = after.unionByName(pieces, allowMissingColumns=True)
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", F.col("after").isNull())
    kept = f"conv_id {conv_type}, {output}"
    return done.unionByName(in_order.mapInArrow(_joined(output, _arrow(kept)), kept))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    c = conversations
    blank = F.lit(" ")
    return c.select(
        c[conv_col].alias("conv_id"), c[turn_col].cast("long").alias("turn"),
        F.coalesce(c[role_col].cast("string"), blank).alias("role"), F.coalesce(c[text_col].cast("string"), blank).alias("text"), F.lit(1).alias("copies"),
    )


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each conversation after the cheapest edits; deleted ones are gone.

    edit: K kept, R in another role, I inserted. Turns are read in order of turn (nulls first), role and text. A text of
    white space only is blank, one whose role and text came before is a duplicate; both go. One whose last character
    is not of ENDS is truncated, and costs CUT if it stays. Roles must begin with s?(ua)+. Equal turns are counted, not
    listed. Conversations are cut into pieces of bounded size over sorted partitions: a piece's edits are found for each
    state in which it may be entered and left, and pieces are put together by those costs, so a long conversation is
    aligned by many tasks; only its pieces' costs, and its kept text, stream through one. Null roles and texts count as
    one space, null conversations as one conversation, an empty table gives no rows, further columns do not matter.
    """
    return _repaired(_turns(conversations, conv_col, turn_col, role_col, text_col), _TURNS)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): conversations(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 removes the ends of sentences, 3 doubles it, 4 makes its
    role user. Nulls count as one space, but a null turn stays null.
    """
    rows = _turns(conversations, "conv_id", "turn", "role", "text")
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = rows.withColumn("fate", F.crc32(key.cast("binary")) % 20).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of conversations.

    Of conversations after `damage`: missing turn numbers, first faults of each turn, pairs of adjacent turns out of
    order, cost and initials of the cheapest edits (see repair; ties ASCII-least), and the SHA-256 of the repaired turns,
    `role:text` joined by newlines. Where nothing is left after damage: zeros, no edits, the hash of nothing. Nulls,
    ties, repeated rows, empty tables and further columns: as for repair. Numbers, audits and hashes of a conversation
    are sums over its pieces; a hash cannot be put together from parts, so its text streams through one task.
    """
    every = conversations.select("conv_id").distinct()
    found = _repaired(damage(conversations), _REPORT).withColumnRenamed("conv_id", "of")
    zero = F.lit(0).cast("long")
    counts = {"gaps": "gaps", "blank": "n_blank", "duplicate": "n_duplicate", "truncated": "n_truncated", "illegal": "n_illegal", "cost": "cost"}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id",
        *(F.coalesce(F.col(c), zero).alias(name) for name, c in counts.items()),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
