"""Repair of conversations: the cheapest edits that make turns alternate, with an audit of them.

Rows of a conversation are kept, given another role or deleted, and empty turns are
inserted, until the initials of the roles read ``(s?(ua)+)?``.  Of all cheapest
edits those with the ASCII-least audit, the initials of the edits in order, count.

A dynamic program walks over the rows with four states.  The audits it weighs are
not strings but nodes that share their prefixes: a node has the last letter, its
ancestors 1, 2, 4, ... letters earlier and a rolling hash of all letters up to it.
Equally cheap audits are compared at their first different letter, which is found
by descending the ancestors as long as hashes differ; that what lies before is
really equal is then verified letter by letter up to the first shared node.

One task reads a conversation row by row: first narrow rows without texts, from
which the edits follow, then the texts in the same order, which are hashed as they
pass.  So only nodes and digests of one conversation are held, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, only_cache, read

SOLID = r"[^\x20\x09-\x0D]"
#: Costs of edits; a kept or rerolled row that is cut short costs one more.
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: States: nothing yet; after the system turn; after a user turn; after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with that initial; others can't follow.
_AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The role that a new or rerolled turn gets in each state, and the state after it.
_NEXT = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
_FINAL = (START, ASSISTANT)
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Edits:
    """A node of the tree of audits: the edits from the first to this one."""

    __slots__ = ("letter", "depth", "hash", "up")
    #: The rolling hash's modulus; smaller only in tests.
    prime = _PRIME

    def __init__(self, letter: str, before: Edits | None):
        self.letter, up = letter, []
        self.depth = before.depth + 1 if before else 0
        self.hash = (before.hash * _BASE + ord(letter)) % self.prime if before else 0
        while before:
            up.append(before)
            k = len(up) - 1
            before = before.up[k] if len(before.up) > k else None
        self.up = up  # up[k]: 2^k letters earlier

    def at(self, depth: int) -> Edits:
        """The ancestor with so many letters."""
        node, left = self, self.depth - depth
        while left:
            k = left.bit_length() - 1
            node, left = node.up[k], left - (1 << k)
        return node

    def text(self) -> str:
        out, node = [], self
        while node.up:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def _split(x: Edits, y: Edits) -> tuple[Edits, Edits]:
    """Of two nodes of one depth that differ: the nodes of the first different letter, or of a later one if hashes collide."""
    while True:
        k = next((k for k in reversed(range(len(x.up))) if x.up[k].hash != y.up[k].hash), None)
        if k is None:
            return x, y
        x, y = x.up[k], y.up[k]


def less(x: Edits, y: Edits) -> bool:
    """Whether x's letters come before y's in ASCII order."""
    if x is y:
        return False
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a.hash != b.hash:
        a, b = _split(a, b)
    # Equal hashes are not equal letters yet: any difference before decides.
    first = (a.letter, b.letter) if a.letter != b.letter else None
    while a.up and a.up[0] is not b.up[0]:
        a, b = a.up[0], b.up[0]
        if a.letter != b.letter:
            first = a.letter, b.letter
    return first[0] < first[1] if first else x.depth < y.depth


class Repair:
    """The dynamic program over one conversation's rows, given one after another."""

    def __init__(self) -> None:
        self.best: list[tuple[int, Edits] | None] = [(0, Edits("", None)), None, None, None]

    @staticmethod
    def _offer(to: list, state: int, cost: int, letter: str, before: Edits) -> None:
        held = to[state]
        if held is None or cost < held[0]:
            to[state] = cost, Edits(letter, before)
        elif cost == held[0]:
            node = Edits(letter, before)
            if less(node, held[1]):
                to[state] = cost, node

    def _insert(self) -> None:
        """Turns inserted here; no more than two in a row are ever worth their cost."""
        for _ in range(2):
            old = list(self.best)
            for state, found in enumerate(old):
                if found:
                    self._offer(self.best, _NEXT[state][1], found[0] + INSERT, "I", found[1])

    def row(self, initial: str, must_go: bool, cut_short: bool) -> None:
        self._insert()
        new: list[tuple[int, Edits] | None] = [None] * 4
        for state, found in enumerate(self.best):
            if not found:
                continue
            cost, edits = found
            self._offer(new, state, cost + DELETE, "D", edits)
            if must_go:
                continue
            cost += CUT_SHORT * cut_short
            if initial in _AFTER[state]:
                self._offer(new, _AFTER[state][initial], cost, "K", edits)
            role, after = _NEXT[state]
            if role[0] != initial:
                self._offer(new, after, cost + REROLE, "R", edits)
        self.best = new

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        self._insert()
        found = [self.best[s] for s in _FINAL if self.best[s]]
        cost, edits = found[0]
        for c, e in found[1:]:
            if c < cost or c == cost and less(e, edits):
                cost, edits = c, e
        return cost, edits.text()


class Repaired:
    """Turns of the repaired conversation, as its audit is followed over the rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role, self.state = _NEXT[self.state]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[self.state][role[:1]]
            yield role, text
        elif edit == "R":
            role, self.state = _NEXT[self.state]
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def repair(rows: list[tuple[str, bool, bool, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired turns) of one conversation in memory: rows of (role, must go, cut short, text)."""
    program = Repair()
    for role, must_go, cut_short, _ in rows:
        program.row(role[:1], must_go, cut_short)
    cost, audit = program.end()
    follow = Repaired(audit)
    turns = [t for role, _, _, text in rows for t in follow.row(role, text)]
    return cost, audit, [*turns, *follow.end()]


# Over a table.

#: Kinds of rows that a task reads of a conversation: facts of all rows first, then all texts.
_FACTS, _TEXTS = 0, 1
_OUT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired_turns", pa.int64()),
])


class _Conversation:
    """What a task holds of the conversation that is passing."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.program, self.seen = conv_id, Repair(), set()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before, self.turns, self.low, self.last = 0, None, 0, None, None
        self.follow, self.hash, self.written = None, hashlib.sha256(), 0

    def fact(self, turn: int | None, role: str, digest: bytes, blank: bool, cut_short: bool) -> None:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last:
            self.low, self.last, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        key = hashlib.blake2b(role.encode() + b"\0" + digest, digest_size=16).digest()
        again = key in self.seen
        self.seen.add(key)
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut_short else None
        if fault:
            self.faults[fault] += 1
        self.program.row(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def _decide(self) -> None:
        if self.follow is None:
            self.cost, self.audit = self.program.end()
            self.follow, self.program, self.seen = Repaired(self.audit), None, None

    def text(self, role: str, text: str) -> None:
        self._decide()
        self._write(self.follow.row(role, text))

    def _write(self, turns: Iterable[tuple[str, str]]) -> None:
        for role, text in turns:
            self.hash.update(f"{chr(10) * (self.written > 0)}{role}:{text}".encode())
            self.written += 1

    def result(self) -> dict:
        self._decide()
        self._write(self.follow.end())
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest(), "repaired_turns": self.written}


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, kind and order, one result row a conversation."""
    only_cache()
    now: _Conversation | None = None
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for conv_id, kind, turn, role, digest, blank, cut_short, text in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or now.conv_id != conv_id:
                    if now:
                        held.append(now.result())
                    now = _Conversation(conv_id)
                if role is None:  # only tells that the conversation is there
                    continue
                if kind == _FACTS:
                    now.fact(turn, role, digest, blank, cut_short)
                else:
                    now.text(role, text)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, schema=_OUT)
                held = []
    if now:
        held.append(now.result())
    yield pa.RecordBatch.from_pylist(held, schema=_OUT)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20; null ids, turns, roles and texts count as one space there.

    0: ``dropped`` is set, the row itself stays here; 1: no text; 2: no ``. ! ?``;
    3: the row comes twice; 4: role user.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("_case", (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).cast("int"))
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(told("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_case") == 0).alias("dropped"), F.when(F.col("_case") == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def repair_conversations(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired_turns.

    Rows for which the column named ``dropped`` is true count for nothing, but their
    conversation is told.
    Rows stand in the order of turn (nulls first), role and SHA-256 of the text,
    so ties of a turn have one order, and rows that repeat follow one another.
    A null role or text counts as one space.  A row's first fault counts: blank,
    duplicate of an earlier row's role and text, truncated (its last character
    that is not white space is none of ``. ! ?``).  Rows without conv_id are one
    conversation.  A conversation without rows has zeros, an empty audit and the
    hash of the empty string; an empty table gives an empty result.  Columns of
    other names stay behind.  Texts of any length pass, one batch at a time.
    """
    blank = ~F.col("text").rlike(SOLID)
    cut_short = ~F.coalesce(F.regexp_extract("text", rf"(?s)({SOLID})[\x20\x09-\x0D]*\z", 1), F.lit("")).isin(".", "!", "?")
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("dropped"))
    d = d.select("conv_id", "turn", F.when(~F.col("dropped"), F.col("role")).alias("role"), "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), blank.alias("blank"), cut_short.alias("cut_short"))
    facts = F.struct(F.lit(_FACTS).alias("kind"), "turn", "role", "digest", "blank", "cut_short", F.lit(None).cast("string").alias("text"))
    texts = F.struct(F.lit(_TEXTS).alias("kind"), "turn", "role", "digest", F.lit(False).alias("blank"), F.lit(False).alias("cut_short"), "text")
    twice = d.select("conv_id", F.inline(F.when(F.col("role").isNull(), F.array(facts)).otherwise(F.array(facts, texts))))
    dealt = twice.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.mapInArrow(_run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired_turns long")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = only(read(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    return repair_conversations(damage(rows), "dropped").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _add(state: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _with_inserts(source: str, extra: str) -> str:
    """SQL: states s0, ss, su, sa of ``source`` after turns inserted there; equal costs by least audit."""
    user, assistant = (lambda s, r=r: _add(s, "2", "I", f"chr(10) || '{r}:'") for r in ("user", "assistant"))
    once = f"SELECT {extra}, s0, ss, least(su, {user('s0')}, {user('ss')}, {user('sa')}) AS su, least(sa, {assistant('su')}) AS sa FROM {source}"
    return f"SELECT {extra}, s0, ss, least(su, {user('sa')}) AS su, least(sa, {assistant('su')}) AS sa FROM ({once})"


def _step(state: str, keeps: list[tuple[str, str]], reroles: list[tuple[str, str]], role: str) -> str:
    """SQL: the best way into a state by one row: deleted there, kept from a state with the initial, rerolled from a state."""
    unreachable = "{'c': 1000000000, 'a': '', 't': ''}"
    ways = [_add(state, "3", "D", "''")]
    ways += [f"CASE WHEN NOT must_go AND initial = '{i}' THEN {_add(s, 'cut', 'K', "chr(10) || role || ':' || text")} ELSE {unreachable} END" for s, i in keeps]
    ways += [f"CASE WHEN NOT must_go AND initial <> '{role[:1]}' THEN {_add(s, '2 + cut', 'R', f"chr(10) || '{role}:' || text")} ELSE {unreachable} END" for s, _ in reroles]
    return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]


_FROM_USER_SIDE = [("s0", "u"), ("ss", "u"), ("sa", "u")]

OP11_SQL = rf"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), told AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
                           lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM conversations CROSS JOIN bits
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM told WHERE fault <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), judged AS (
    SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open_end,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous
    FROM ordered
), rows AS (
    SELECT *, blank OR again AS must_go, (NOT blank AND NOT again AND open_end)::int AS cut FROM judged
), walk AS (
    SELECT conv_id, 0::bigint AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000000, 'a': '', 't': ''}} AS ss,
           {{'c': 1000000000, 'a': '', 't': ''}} AS su, {{'c': 1000000000, 'a': '', 't': ''}} AS sa
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i,
           {_step("s0", [], [], "")} AS s0,
           {_step("ss", [("s0", "s")], [], "")} AS ss,
           {_step("su", _FROM_USER_SIDE, _FROM_USER_SIDE, "user")} AS su,
           {_step("sa", [("su", "a")], [("su", "a")], "assistant")} AS sa
    FROM ({_with_inserts("(SELECT w.conv_id, r.i, r.role, r.text, r.initial, r.must_go, r.cut, s0, ss, su, sa FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)", "conv_id, i, role, text, initial, must_go, cut")})
), facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
           sum(cut) AS truncated, count_if(previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id
), ended AS (
    SELECT conv_id, least(s0, sa) AS best FROM ({_with_inserts("(SELECT w.* FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(f.n, 0))", "conv_id")})
)
SELECT e.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
       coalesce(illegal, 0)::bigint AS illegal, best.c::bigint AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
