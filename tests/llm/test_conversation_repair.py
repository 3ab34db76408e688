import hashlib
import itertools
import random
import re
import zlib
from heapq import heappop, heappush

from fixtures import SF, SF2

from tariffloom.llm import conversation_repair as C
from tariffloom.llm.conversation_repair import damaged, matrix, op11_conversation_repair, repair, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, n int, kind string"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(turns):
    """Best-first search over (cost, audit) with the grammar spelled out as roles."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit
        to = [r for r in "ua" if r in STEP[state]]
        for r in to:
            heappush(heap, (cost + 5, audit + "I", i, r))
        if i < len(turns):
            role, gone, cut = turns[i]
            heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if not gone:
                if role in STEP[state]:
                    heappush(heap, (cost + 5 * cut, audit + "K", i + 1, STEP[state][role]))
                for r in to:
                    heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, r))


def brute(rows):
    """rows: (conv_id, turn, role, text) after damage, or None for a dropped one."""
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        rows = sorted((r[1:] for r in group if r[2] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in (0, 1), fault == 2))
        roles = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(turns)
        i, state, left = 0, "", []
        for e in audit:
            role, text = (None, "") if e == "I" else rows[i][1:]
            i += e != "I"
            if e == "D":
                continue
            if e == "K":
                state = role[:1]
            else:
                state = "a" if state == "u" else "u"
                role = {"u": "user", "a": "assistant"}[state]
            left.append(f"{role}:{text}")
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            yield conv, turn, None, None
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        yield from [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)


def told(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.select(C.REPORT).collect()}


def test_least_cost_and_audit_against_search():
    rng = random.Random(5)
    for n in range(9):
        for _ in range(120):
            turns = [(rng.choice(["s", "u", "u", "a", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            turns = [(a, b, c and not b) for a, b, c in turns]
            cost, edits = repair(turns)
            assert (cost, "".join(e[0] for e in edits)) == cheapest(turns)


def test_matrices_chain():
    rng = random.Random(6)
    end = matrix([], True)
    for _ in range(60):
        turns = [(rng.choice("suaua"), rng.random() < 0.2, False) for _ in range(12)]
        m, k = [[0 if q == f else C.NEVER for f in range(4)] for q in range(4)], rng.randint(1, 11)
        for part in (turns[:k], turns[k:]):
            x = matrix(part)
            m = [[min(m[q][e] + x[4 * e + f] for e in range(4)) for f in range(4)] for q in range(4)]
        assert min(m[0][f] + min(end[4 * f], end[4 * f + 3]) for f in range(4)) == repair(turns)[0]


def test_query_against_brute_force(spark):
    for sf in (SF, SF2):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert told(op11_conversation_repair(spark, sf)) == brute(damage(rows))


def odd_rows():
    rng, rows = random.Random(7), []
    texts = ["Yes.", "No!", "why", "", " \t\n", "a\n.", "ü?", None, "Yes. ", "é"]
    for conv in range(60):
        for k in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([k, k, k, None, 2 * k, 3]), rng.choice(["user", "assistant", "system", None, "tool", "usher", ""]), rng.choice(texts)))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (99, None, "user", "x" * 300000 + "."), (98, -5, "system", "y. " * 50000)]
    return [(*r, 1, "x") for r in rows]


def test_odd_rows(spark):
    rows = odd_rows()
    assert told(repair_report(damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(damage([r[:4] for r in rows]))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(none)).collect() == [] and repaired_turns(none).collect() == []


def test_long_conversations_equal_short_ones(spark):
    rng = random.Random(8)
    rows = odd_rows() + [(500 + c, rng.choice([k, k + 1, None, -k]), rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"n{k // 3}", f"t{k}.", f"u{k}!"]), 1, "x") for c in range(3) for k in range(rng.randint(30, 90))]
    want = brute(damage([r[:4] for r in rows]))
    frame = damaged(spark.createDataFrame(rows, SCHEMA))
    for whole, span, segment in ((2, 4, 3), (20, 16, 8), (5, 1, 1)):
        assert told(repair_report(frame, whole=whole, span=span, segment=segment)) == want


def test_repaired_turns_follow_the_grammar(spark):
    rows = repaired_turns(damaged(spark.read.parquet(f"{SF2}/conversations.parquet"))).orderBy("conv_id", "range", "part", "place").collect()
    for _, group in itertools.groupby(rows, key=lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in group))
