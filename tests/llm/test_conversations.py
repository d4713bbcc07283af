import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from scorewright.llm import conversations as op

SHAPE = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, turns) by a search over all edits, cheapest first, equal costs by audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, out, turns = heapq.heappop(heap)
        if i == len(rows) and SHAPE.fullmatch(out):
            return cost, audit, list(turns)
        state = (i, out if len(out) < 2 else out[-1:] + "+")
        if state in done:
            continue
        done.add(state)
        step = lambda c, letter, j, role, text: heapq.heappush(heap, (cost + c, audit + letter, j, out + role[:1], (*turns, (role, text))))
        fits = lambda role: SHAPE.fullmatch(out + role[:1] + "ua") or SHAPE.fullmatch(out + role[:1] + "a") or SHAPE.fullmatch(out + role[:1])
        for role in ("user", "assistant"):
            if fits(role):
                step(2, "I", i, role, "")
        if i < len(rows):
            role, must_go, cut, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, turns))
            if not must_go:
                if role[:1] in ("s", "u", "a") and fits(role):
                    step(cut, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    if fits(new) and new[:1] != role[:1]:
                        step(2 + cut, "R", i + 1, new, text)


def brute(rows):
    """The contract row of one conversation, from its rows (turn, role, text) after damage, in order."""
    seen, facts, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        facts.append((role, fault in ("blank", "duplicate"), fault == "truncated", text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(facts)
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def damaged(rows, damage=True):
    out = {}
    for conv, turn, role, text in rows:
        told = [" " if x is None else x for x in (conv, turn, role, text)]
        case, (_, _, role, text) = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20 if damage else 9, told
        held = out.setdefault(conv, [])
        if case != 0:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            held += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(held, key=order) for conv, held in out.items()}


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS[1:]) for r in df.collect()}


def odd_rows(seed, n):
    rnd = random.Random(seed)
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Assistant"])
    text = lambda: rnd.choice(["a.", "b", "c!", " ", "", None, "d? \n", "e ", "x.\r\n\t y", "é.", "long " * 2000 + "."])
    rows = [(rnd.choice([*range(n // 6), None]), rnd.choice([*range(12), None]), role(), text()) for _ in range(n)]
    return rows + rows[:5]


def test_program_against_search():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rnd.random() < 0.15, rnd.random() < 0.3, str(i)) for i in range(rnd.randint(0, 11))]
        assert op.repair(rows) == cheapest(rows), rows


@pytest.mark.parametrize("prime", [7, 101])
def test_colliding_hashes(prime, monkeypatch):
    monkeypatch.setattr(op.Edits, "prime", prime)
    rnd = random.Random(prime)
    words = ["".join(rnd.choice("DIKR") for _ in range(rnd.randint(0, 24))) for _ in range(60)]
    nodes = {}
    for w in words:  # prefixes are shared as far as one word continues another
        node = op.Edits("", None)
        for k, letter in enumerate(w, 1):
            node = nodes.setdefault(w[:k], op.Edits(letter, node))
        nodes.setdefault(w, node)
    for a in words:
        for b in words:
            assert op.less(nodes[a], nodes[b]) == (a < b), (a, b)
    rows = [(rnd.choice(["user", "assistant", "system"]), False, rnd.random() < 0.3, str(i)) for i in range(60)]
    got = op.repair(rows)
    monkeypatch.undo()
    assert got == op.repair(rows) == cheapest(rows)


def test_long_conversation():
    rnd = random.Random(9)
    rows = [(rnd.choice(["user", "assistant"]), rnd.random() < 0.1, False, "t") for _ in range(20_000)]
    cost, audit, turns = op.repair(rows)
    assert len(audit) - audit.count("I") == len(rows) and SHAPE.fullmatch("".join(r[:1] for r, _ in turns))
    assert cost == 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I"))


def test_table(spark):
    rows = odd_rows(5, 240)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(op.repair_conversations(op.damage(df), "dropped"))
    want = {conv: brute(held) for conv, held in damaged(rows).items()}
    assert got == want
    # Other columns, also of names used inside, and any layout.
    clash = op.damage(df).withColumn("kind", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("blank", F.lit("y")).withColumn("facts", F.lit(0)).repartition(7)
    assert rows_of(op.repair_conversations(clash, "dropped")) == want
    whole = df.withColumn("dropped", F.lit("no mark"))
    assert rows_of(op.repair_conversations(whole)) == {conv: brute(held) for conv, held in damaged(rows, damage=False).items()}


def test_against_sql(spark):
    rows = odd_rows(11, 150)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(op.OP11_SQL)
    names = [c[0] for c in found.description]
    got = {r[names.index("conv_id")]: tuple(r[names.index(c)] for c in COLUMNS[1:]) for r in found.fetchall()}
    assert got == {conv: brute(held) for conv, held in damaged(rows).items()}


def test_all_dropped_and_empty(spark):
    gone = next((c, t) for c in range(50) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "hello.")], "conv_id long, turn long, role string, text string")
    assert rows_of(op.repair_conversations(op.damage(df), "dropped")) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert op.repair_conversations(op.damage(df.limit(0)), "dropped").count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op.op11_conversation_repair(spark, sf)
    assert df.columns == COLUMNS
    assert rows_of(df) == {conv: brute(held) for conv, held in damaged(rows).items()}
