"""Least-cost repair of the turn structure of conversations, by layers of cost.

The grammar of roles ``(s?(ua)+)?`` has four states. For each cost 0, 1, 2 ... a
layer holds, for each place between turns, the bit set of the states from which
the rest can be finished at exactly that cost: a turn is kept (its cost's layer,
next place), given another role (one layer lower), deleted (two lower), or an
empty turn is put in front of it (five lower, same place). The first layer whose
first place holds the starting state gives the cost; walking the bits forward,
always by the first letter that leads on, gives the least audit.

Conversations of at most WHOLE rows are repaired in one piece, as a task streams
through them. Longer ones are cut into segments by ranges of turns, so that no
task gets a long conversation: a segment's layers are made for all four exits at
once (16 bits a place), the costs of segments are chained per conversation, and
each segment is then walked on its own from its known entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

WHOLE, RANGE, SEGMENT = 512, 256, 256
#: Costs of the edits, fixed by the contract; letters in the order of ties.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. The user or assistant turn that each one waits for.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = ["", "", "user", "assistant"]
ENDS = 1 << START | 1 << ASSISTANT
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")


def _before(step: list[int | None]) -> list[int]:
    """For each set of states, four sets side by side, those that ``step`` takes into it."""
    one = [sum(1 << q for q in range(4) if step[q] is not None and s >> step[q] & 1) for s in range(16)]
    sets = np.arange(1 << 16)
    return sum(np.array(one)[sets >> k & 15] << k for k in (0, 4, 8, 12)).tolist()


STEPS = {"s": [SYSTEM, None, None, None], "u": [USER, USER, None, USER], "a": [None, None, ASSISTANT, None], "": [None] * 4}
_KEEP = {c: _before(s) for c, s in STEPS.items()}
_PLACE = _before(NEXT)
#: Each state as its own exit.
_EXITS = sum(1 << 5 * q for q in range(4))


def exits_of(turns: list[tuple[str, bool, bool]]) -> int:
    """All pairs of exit and entry that some edits join; a system turn is only ever kept."""
    leads = [(START, START), (START, USER), (START, ASSISTANT), (SYSTEM, SYSTEM), *((q, f) for q in (SYSTEM, USER, ASSISTANT) for f in (USER, ASSISTANT))]
    if any(role == "s" and not gone for role, gone, _ in turns):
        leads.append((START, SYSTEM))
    return sum(1 << (4 * f + q) for q, f in leads)


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def layers(turns: list[tuple[str, bool, bool]], ends: int, done: int, last: bool) -> list[list[int]]:
    """The bit sets of ``turns`` (initial, to be deleted, truncated), cost by cost, until the first place holds ``done``.

    ``last``: nothing follows, so turns may also be put at the end.
    """
    n, out = len(turns), []
    none = [0] * (n + 1)
    seen = 0
    while seen & done != done:
        d = len(out)
        one, two, five, six = (out[d - k] if d >= k else none for k in (1, 2, 5, 6))
        row = none[:]
        row[n] = x = (ends if d == 0 else 0) | (_PLACE[five[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            role, gone, cut = turns[i]
            y = two[i + 1] | _PLACE[five[i]]
            if not gone:
                y |= _KEEP[role][five[i + 1]] | _PLACE[six[i + 1]] if cut else _KEEP[role][x] | _PLACE[one[i + 1]]
            row[i] = x = y
        out.append(row)
        seen |= x
    return out


def walk(turns: list[tuple[str, bool, bool]], made: list[list[int]], state: int, rest: dict[int, int], last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The least audit from ``state`` as (letter, turn or -1, state after), and the exit.

    ``rest``: for each exit's shift in the bit sets, the cost that is left for this segment.
    """
    edits, i, n = [], 0, len(turns)

    def leads(q: int | None, at: int, cost: int) -> bool:
        return q is not None and any(0 <= (d := left - cost) < len(made) and made[d][at] >> (shift + q) & 1 for shift, left in rest.items())

    def spend(cost: int) -> None:
        for shift in rest:
            rest[shift] -= cost

    while True:
        if i < n:
            role, gone, cut = turns[i]
            extra = TRUNCATED if cut else 0
            if leads(state, i + 1, DELETE):
                edits.append(("D", i, state))
                spend(DELETE)
                i += 1
                continue
        if (i < n or last) and leads(NEXT[state], i, INSERT):
            state = NEXT[state]
            edits.append(("I", -1, state))
            spend(INSERT)
            continue
        if i == n:
            return edits, state
        for letter, to, cost in (("K", STEPS[role][state], extra), ("R", NEXT[state], REROLE + extra)):
            if not gone and leads(to, i + 1, cost):
                state = to
                edits.append((letter, i, state))
                spend(cost)
                i += 1
                break
        else:
            raise AssertionError("no edit leads on")


def repair(turns: list[tuple[str, bool, bool]]) -> tuple[int, list[tuple[str, int, int]]]:
    """Cost and edits of a whole conversation."""
    made = layers(turns, ENDS, 1 << START, True)
    cost = len(made) - 1
    return cost, walk(turns, made, START, {0: cost}, True)[0]


def prepared(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with nulls of role and text as one space, the range of turns, a digest for duplicates, and faults that a row has alone."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], *(["present"] if "present" in rows.columns else [F.lit(True).alias("present")]))
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    return rows.select(
        "*",
        F.expr(f"turn div {span} - if(turn < 0 and turn % {span} <> 0, 1, 0)").alias("range"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
        (tail == "").alias("blank"),
        (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


_ROW = ["conv_id", "range", "turn", "role", "text", "same", "blank", "cut", "kind"]
COUNTS = ("n", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal")
EDITS = "edits array<struct<edit:string,role:string,text:string>>"
PIECE = f"conv_id long, range long, part long, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, cost long, {EDITS}, matrix array<long>"
_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_KEY = [(c, pa.int64()) for c in ("conv_id", "range", "part")]
_PIECE = pa.schema([*_KEY, *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("edits", _EDITS), ("matrix", pa.list_(pa.int64()))])
#: Kinds of rows in a group, in their order: digest of a row in an earlier range, row, row that isn't there.
CARRIED, TURN, ABSENT = range(3)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _judged(rows: list[tuple], seen: set, last_turn) -> tuple[dict, list[tuple[str, bool, bool]]]:
    """Counts of a piece, and its turns for ``layers``."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    turns, before = [], None
    for _, _, turn, role, _, same, blank, cut, _ in rows:
        again = not blank and same in seen
        cut = cut and not blank and not again
        seen.add(same)
        counts["blank"] += blank
        counts["duplicate"] += again
        counts["truncated"] += cut
        counts["illegal"] += before is not None and before + role[:1] not in LEGAL
        counts["turns"] += turn is not None and turn != last_turn
        before, last_turn = role[:1], turn
        turns.append((initial(role), blank or again, cut))
    known = [r[2] for r in rows if r[2] is not None]
    return counts | {"n": len(rows), "lo": min(known, default=None), "hi": max(known, default=None), "first": rows[0][3][:1] if rows else None, "last": before}, turns


def _named(rows: list[tuple[str, str]], edits: list[tuple[str, int, int]]) -> list[dict]:
    """Edits with the repaired role and text; a deleted row's are its own."""
    out = []
    for letter, i, state in edits:
        role, text = (ROLE[state], "") if i < 0 else rows[i]
        out.append({"edit": letter, "role": ROLE[state] if letter == "R" else role, "text": text})
    return out


def _emit(pieces: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += 1 + piece["n"]
        if size >= 2000:
            yield pa.RecordBatch.from_pylist(held, schema=_PIECE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_PIECE)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for (conv_id,), group in groupby(_rows(batches), key=lambda r: r[:1]):
            rows = [r for r in group if r[8] == TURN]
            counts, turns = _judged(rows, set(), None)
            cost, edits = repair(turns)
            yield {"conv_id": conv_id, "range": None, "part": 0, "cost": cost, "edits": _named([r[3:5] for r in rows], edits), "matrix": None} | counts

    return _emit(pieces())


def _segments(group: Iterator[tuple], segment: int) -> Iterator[tuple[int, list[tuple], dict, list]]:
    seen, rows, part, before = set(), [], 0, None
    for row in group:
        if row[8] == CARRIED:
            seen.add(row[5])
            continue
        rows.append(row)
        if len(rows) == segment:
            yield part, rows, *_judged(rows, seen, before)
            before, rows, part = rows[-1][2], [], part + 1
    if rows:
        yield part, rows, *_judged(rows, seen, before)


def matrix(turns: list[tuple[str, bool, bool]], last: bool = False) -> list[int]:
    """Least cost from each entry to each exit, row by row; NEVER where there is none."""
    out = [NEVER] * 16
    for d, row in enumerate(layers(turns, _EXITS, exits_of(turns), last)):
        for f in range(4):
            for q in range(4):
                if out[4 * q + f] == NEVER and row[0] >> (4 * f + q) & 1:
                    out[4 * q + f] = d
    return out


def _cut(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Segments; in place of edits they hold their rows, each with what ``layers`` takes of it."""

    def pieces():
        for (conv_id, place), group in groupby(_rows(batches), key=lambda r: r[:2]):
            for part, rows, counts, turns in _segments(group, segment):
                own = [{"edit": a + "D" * b + "C" * c, "role": r[3], "text": r[4]} for (a, b, c), r in zip(turns, rows, strict=True)]
                yield {"conv_id": conv_id, "range": place, "part": part, "cost": None, "edits": own, "matrix": matrix(turns)} | counts

    return _emit(pieces())


def _turns(own: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(o["edit"].rstrip("DC"), "D" in o["edit"], "C" in o["edit"]) for o in own]


def _walk_segment(own: list[dict], after: list[int], total: list[int], entry: int) -> tuple[list[tuple[str, int, int]], int]:
    turns = _turns(own)
    made = layers(turns, _EXITS, exits_of(turns), False)
    return walk(turns, made, entry, {4 * f: total[entry] - after[f] for f in range(4) if after[f] < NEVER}, False)


def _in_order(pieces: pa.Table) -> list[dict]:
    return sorted(pieces.to_pylist(), key=lambda r: (r["range"] is not None, r["range"], r["part"]))


_CHAINED = pa.schema([*_KEY, ("after", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())), ("at_end", pa.bool_()), ("seam", pa.int64())])
CHAINED = "conv_id long, range long, part long, after array<long>, total array<long>, at_end boolean, seam long"


def _chain(pieces: pa.Table) -> pa.Table:
    """For each segment of a conversation the least cost to the end from its exits and from its entries; seams that aren't legal."""
    rows = _in_order(pieces)
    end = matrix([], True)
    value = [min(end[4 * q + START], end[4 * q + ASSISTANT]) for q in range(4)]
    for row, follows in zip(reversed(rows), [None, *reversed(rows)], strict=False):
        m = row["matrix"]
        row["after"], row["at_end"] = value, follows is None
        row["total"] = value = [min(NEVER, *(m[4 * q + f] + value[f] for f in range(4))) for q in range(4)]
    for row, before in zip(rows, [None, *rows], strict=False):
        row["seam"] = int(before is not None and before["last"] + row["first"] not in LEGAL)
    return pa.Table.from_pylist([{f.name: r[f.name] for f in _CHAINED} for r in rows], schema=_CHAINED)


_EXITED = pa.schema([*_KEY, ("exits", pa.list_(pa.int64()))])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the least audit leads from each entry."""
    for batch in batches:
        rows = []
        for own, after, total in zip(*(batch.column(c).to_pylist() for c in ("edits", "after", "total")), strict=True):
            rows.append([_walk_segment(own, after, total, q)[1] if total[q] < NEVER else None for q in range(4)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "range", "part")), pa.array(rows, pa.list_(pa.int64()))], schema=_EXITED)


_ENTERED = pa.schema([*_KEY, ("entry", pa.int64())])


def _entries(pieces: pa.Table) -> pa.Table:
    rows, state = _in_order(pieces), START
    for row in rows:
        row["entry"], state = state, row["exits"][state]
    return pa.Table.from_pylist([{f.name: r[f.name] for f in _ENTERED} for r in rows], schema=_ENTERED)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edits, costs = [], []
        for own, after, total, at_end, entry in zip(*(batch.column(c).to_pylist() for c in ("edits", "after", "total", "at_end", "entry")), strict=True):
            steps, state = _walk_segment(own, after, total, entry)
            cost = total[entry] - after[state]
            while at_end and not ENDS >> state & 1:
                state = NEXT[state]
                steps.append(("I", -1, state))
                cost += INSERT
            costs.append(cost)
            edits.append(_named([(o["role"], o["text"]) for o in own], steps))
        made = {"edits": pa.array(edits, _EDITS), "cost": pa.array(costs, pa.int64())}
        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in _PIECE], schema=_PIECE)


def _same_piece(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & a["range"].eqNullSafe(b["range"]) & (a["part"] == b["part"])


def _repaired_long(rows: DataFrame, segment: int) -> DataFrame:
    """Pieces of the conversations that go through no task as a whole."""
    early = F.coalesce("range", F.lit(-(1 << 62)))
    digests = rows.groupBy("conv_id", "same", "range").agg(F.count("*").alias("n"))
    first = digests.groupBy("conv_id", "same").agg(F.min(early).alias("since"), F.count("*").alias("k")).where("k > 1")
    met = digests.join(first.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "since"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")))
    nothing = {"turn": "long", "role": "string", "text": "string", "blank": "boolean", "cut": "boolean"}
    carried = met.where(F.col("range") > F.col("since")).select("conv_id", "range", "same", F.lit(CARRIED).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    dealt = rows.select(_ROW).unionByName(carried).repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "kind", "turn", "role", "text")
    pieces = written(dealt.mapInArrow(lambda batches: _cut(batches, segment), PIECE), "segments")
    small = pieces.select("conv_id", "range", "part", "matrix", "first", "last")
    chained = written(small.groupBy("conv_id").applyInArrow(_chain, CHAINED), "chained")
    joined = pieces.join(chained, _same_piece(pieces, chained)).select(pieces["*"], "after", "total", "at_end", "seam")
    exits = joined.select("conv_id", "range", "part", "edits", "after", "total").mapInArrow(_exits, "conv_id long, range long, part long, exits array<long>")
    entries = written(exits.groupBy("conv_id").applyInArrow(_entries, "conv_id long, range long, part long, entry long"), "entries")
    ready = joined.join(entries, _same_piece(pieces, entries)).select(*[pieces[c] for c in pieces.columns], "after", "total", "at_end", "seam", "entry")
    return ready.withColumn("illegal", F.col("illegal") + F.col("seam")).drop("seam").mapInArrow(_walked, PIECE)


def repaired_pieces(conversations: DataFrame, whole: int = WHOLE, span: int = RANGE, segment: int = SEGMENT) -> DataFrame:
    """The edits of each conversation, each with the role and text it leaves, in pieces by (range, part).

    ``conversations``: conv_id, turn, role, text, any further columns are left
    aside; with a boolean column ``present`` the rows where it is false only say
    that a conversation is there. Rows are taken by turn (nulls first), ties by
    role, then text. Nulls of role and text count as one space, a null conv_id is
    a conversation. A role that doesn't start with s, u or a can only be changed
    or deleted. A conversation without rows has one piece without edits, and an
    empty table none. Counts of faults are those before the repair. ``whole``:
    the piece is the whole conversation.

    A conversation of more than ``whole`` rows is dealt by ranges of ``span`` turns; rows
    of one range, so also all of its rows without a turn, are streamed through one
    task, which holds ``segment`` of them and the digests of the range. One task
    chains the costs of a conversation's segments (16 numbers for each).
    """
    rows = prepared(conversations, span)
    sizes = rows.where("present").groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > whole)
    long_ids = written(sizes.select(F.col("conv_id").alias("long_id")), "long-conversations")
    there = F.col("conv_id").eqNullSafe(F.col("long_id"))
    kinds = rows.withColumn("kind", F.when(F.col("present"), TURN).otherwise(ABSENT)).select(_ROW)
    short = kinds.join(long_ids, there, "left_anti")
    pieces = short.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").mapInArrow(_whole, PIECE)
    out = pieces.withColumn("whole", F.lit(True))
    if not long_ids.isEmpty():
        long = kinds.join(long_ids, there, "left_semi").where(F.col("kind") == TURN)
        out = out.unionByName(_repaired_long(long, segment).withColumn("whole", F.lit(False)))
    return out.drop("matrix")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, their rows in order by (range, part, place), role, text, and the edit that left the row."""
    pieces = repaired_pieces(conversations)
    rows = pieces.select("conv_id", "range", "part", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'")
    return rows.select("conv_id", "range", "part", "place", "e.edit", "e.role", "e.text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv_id,), group in groupby(_rows(batches), key=lambda r: r[:1]):
        digest, audit, first = hashlib.sha256(), [], True
        for _, _, _, edits in group:
            audit.append("".join(e["edit"] for e in edits))
            for e in edits:
                if e["edit"] != "D":
                    digest.update(("" if first else "\n").encode() + f"{e['role']}:{e['text']}".encode())
                    first = False
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv_id], pa.int64()), "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_report(conversations: DataFrame, **sizes: int) -> DataFrame:
    """Per conversation: faults before the repair, its cost, audit and the hash of what it leaves.

    A hash is made in the order of its bytes, so the repaired text of a conversation
    of more than WHOLE rows streams through one task, piece by piece.
    """
    pieces = written(repaired_pieces(conversations, **sizes), "repaired")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    left = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    short = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.sha2(F.array_join(left, "\n"), 256).alias("repaired_sha256"))
    cut = pieces.where("not whole")
    if cut.isEmpty():
        return short.select(REPORT)
    sums = cut.groupBy("conv_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")])
    texts = cut.select("conv_id", "range", "part", "edits").repartition("conv_id").sortWithinPartitions("conv_id", "range", "part").mapInArrow(_streamed, "conv_id long, audit string, repaired_sha256 string")
    long = sums.join(texts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("gaps", gaps)
    return short.select(REPORT).unionByName(long.select(REPORT))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of their conversation and turn: dropped, emptied, without marks, repeated, or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_report(damaged(table(spark, sf_dir, "conversations")))
