"""Repair of conversations whose turns were lost, repeated, emptied, cut or mislabelled.

A conversation in order should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a
system turn, then user and assistant in turn. Edits and their costs: Keep 0, Rerole to user
or assistant 2, Delete 3, Insert an empty turn 2; a truncated turn that stays costs 1 more; a
blank turn or one that repeats an earlier role and text must be deleted. Of the cheapest
repairs the one whose letters are least in ASCII order is taken.

The repair is a path in a graph of places between rows and four states (nothing yet, after
system, after user, after assistant). The cheapest costs from the begin to every node and from
every node to the end mark the tight arcs, those of some cheapest path: an arc from p to q is
tight where forward[p] + cost + backward[q] is least. From the begin, the set of nodes that the
letters so far can have reached is carried on, and the least letter that any tight arc of
theirs bears is taken. Rows come in 12 kinds and costs, less their minimum, in a handful of
vectors, so both passes and the walk look their steps up in tables that fill as they go.

As Spark jobs: (1) rows get a digest of conversation, role and text; digests that occur more
than once and their first turn are found by map-side sums and joined back, which a hot digest
does not gather; (2) rows without their texts, one byte each, are sorted by conversation and
turn and streamed; (3) the letters go before the texts, sorted the same way, and the repaired
turns are written as the texts stream by. A task keeps three bytes for each row of the
conversation it is in. The result holds one letter a row in one cell and one SHA-256 over all
texts of a conversation, so a conversation is streamed through one task by the result's form;
it is sorted on disk and never collected.

Edge cases. Null roles and texts are one space; a null conversation id is a conversation of
its own. Turns are ordered nulls first, rows of one turn by the digest of role and text, equal
rows in any order (they are alike). A conversation without rows has zeros, no letters and the
digest of nothing. An empty table gives an empty result. Of the table's columns only the four
named are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm.common import ship
from kinset.llm.resample import crc_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# Row codes: class of the role's initial, fault times 4, 16 where the digest came in an earlier turn.
CLASSES = ("s", "u", "a")
OTHER = 3
#: Classes that may follow each other: su, ua, au
LEGAL = {(0, 1), (1, 2), (2, 1)}
FINE, BLANK, CUT, ABSENT = 0, 4, 8, 12
LATER = 16

_FAR = 1 << 20
_STATES = range(4)
#: state -> state by a user turn and by an assistant turn; 0 nothing yet, 1 system, 2 user, 3 assistant
_USER, _ASSISTANT, _SYSTEM = {0: 2, 1: 2, 3: 2}, {2: 3}, {0: 1}
_TURN = _USER | _ASSISTANT
_DONE = (0, 3)


def _row_arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of the ways over a row of this code."""
    out = [("D", DELETE, p, p) for p in _STATES]
    fault = code & 12
    if fault != BLANK and not code & LATER:
        more = TRUNCATED * (fault == CUT)
        kept = (_SYSTEM, _USER, _ASSISTANT, {})[code & 3]
        out += [("K", KEEP + more, p, q) for p, q in kept.items()]
        out += [("R", REROLE + more, p, q) for p, q in _TURN.items()]
    return out


def _closed(costs: list[int], backward: bool) -> tuple[int, ...]:
    """The costs with turns inserted where that is cheaper."""
    for _ in range(3):
        for p, q in _TURN.items():
            a, b = (q, p) if backward else (p, q)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return tuple(costs)


def _based(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(min(c - low, _FAR) for c in costs), low


_BEGIN = _closed([0, _FAR, _FAR, _FAR], False)
_END = _closed([0 if p in _DONE else _FAR for p in _STATES], True)


@lru_cache(None)
def _before(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end from before the row, from those after it; based, with what was taken off."""
    out = [_FAR] * 4
    for _, cost, p, q in _row_arcs(code):
        out[p] = min(out[p], cost + after[q])
    return _based(_closed(out, True))


@lru_cache(None)
def _step(nodes: frozenset[int], ahead: tuple[int, ...], code: int, after: tuple[int, ...]) -> tuple[str, frozenset[int], tuple[int, ...]]:
    """(letters, nodes, forward costs) after the row: inserted turns, then one letter for the row.

    ahead are the forward costs before the row, after the backward costs behind it.
    """
    arcs = _row_arcs(code)
    # every path crosses the row once, so the least sum over its arcs is that of the best paths
    best = min(ahead[p] + cost + after[q] for _, cost, p, q in arcs)
    back, low = _before(after, code)
    letters = ""
    while True:
        tight = {(letter, q) for letter, cost, p, q in arcs if p in nodes and ahead[p] + cost + after[q] == best}
        tight |= {("I", q) for p, q in _TURN.items() if p in nodes and ahead[p] + INSERT + back[q] + low == best}
        least = min(letter for letter, _ in tight)
        letters += least
        nodes = frozenset(q for letter, q in tight if letter == least)
        if least != "I":
            break
    out = [_FAR] * 4
    for _, cost, p, q in arcs:
        out[q] = min(out[q], ahead[p] + cost)
    return letters, nodes, _based(_closed(out, False))[0]


@lru_cache(None)
def _tail(nodes: frozenset[int]) -> str:
    """The turns that are inserted behind the last row; all nodes lie on best paths."""
    letters = ""
    while not nodes & set(_DONE):
        letters += "I"
        nodes = frozenset(_TURN[p] for p in nodes)
    return letters


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair of rows with these codes."""
    behind, cost = [], 0
    after = _END
    for code in reversed(codes):
        behind.append(after)
        after, low = _before(after, code)
        cost += low
    cost += after[0]
    # a shared tuple for each place: 8 bytes a row
    nodes, ahead, letters = frozenset([0]), _BEGIN, []
    for code in codes:
        more, nodes, ahead = _step(nodes, ahead, code, behind.pop())
        letters.append(more)
    return cost, "".join(letters) + _tail(nodes)


def _row_digest(conv: Column, role: Column, text: Column) -> Column:
    """SHA-256 of the three, each with its length before it but the last."""
    name = F.coalesce(F.concat(F.lit("s"), conv.cast("string")), F.lit("t"))
    return F.unhex(F.sha2(F.concat(F.length(name), F.lit(":"), name, F.length(role), F.lit(":"), role, text), 256))


def prepared(convs: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, digest, code) of rows with conv_id, turn, role, text.

    Rows that are not present only make their conversation known; their digest is null.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    here = F.lit(True) if present is None else present
    rows = convs.select("conv_id", F.when(here, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    last = F.rtrim("text", F.lit(SPACE))
    kind = F.lit(OTHER)
    for k, initial in enumerate(CLASSES):
        kind = F.when(F.substring("role", 1, 1) == initial, F.lit(k)).otherwise(kind)
    fault = F.when(~F.col("here"), F.lit(ABSENT)).when(last == "", F.lit(BLANK)).when(F.right(last, F.lit(1)).isin(*STOPS), F.lit(FINE)).otherwise(F.lit(CUT))
    digest = F.when(F.col("here"), _row_digest(F.col("conv_id"), F.col("role"), F.col("text")))
    return rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), (kind + fault).alias("code"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, code) with LATER on rows whose digest came in an earlier turn."""
    narrow = rows.select("conv_id", "turn", "digest", "code")
    compared = F.col("digest").isNotNull() & (F.col("code").bitwiseAND(12) != BLANK)
    # lost and blank rows repeat nothing: they are no hot group of the join
    whole, rest = narrow.where(compared), narrow.where(~compared)
    again = whole.groupBy("digest").agg(F.count("*").alias("n"), F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("low")).where("n > 1")
    joined = whole.join(again, "digest", "left")
    later = F.col("n").isNotNull() & F.col("turn").isNotNull() & ((F.col("nulls") > 0) | (F.col("turn") > F.col("low")))
    marked = joined.select("conv_id", "turn", "digest", (F.col("code") + F.when(later, F.lit(LATER)).otherwise(F.lit(0))).alias("code"))
    return marked.unionByName(rest).withColumn("code", F.col("code").cast("tinyint"))


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """The ranges of equal neighbours, null being a value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = pc.run_end_encode(column).run_ends.to_pylist() if len(column) else []
    return list(zip([0, *ends[:-1]], ends))


class _Open:
    """What is kept of the conversation that is being read: a byte a row, no texts."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.low = self.high = self.turn = self.digest = None
        self.distinct = 0

    def add(self, turns: list, digests: list, codes: list) -> None:
        for turn, digest, code in zip(turns, digests, codes):
            if code & 12 == ABSENT:
                continue
            if self.codes and turn == self.turn and digest == self.digest:
                code |= LATER
            elif turn is not None and turn != self.turn:
                self.distinct += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
            self.turn, self.digest = turn, digest
            self.codes.append(code)

    def record(self) -> dict:
        tally = {c: self.codes.count(c) for c in set(self.codes)}
        count = lambda test: sum(n for c, n in tally.items() if test(c))
        kinds = [c & 3 for c in self.codes]
        cost, audit = repair(bytes(self.codes))
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.distinct,
            "blank": count(lambda c: c & 12 == BLANK),
            "duplicate": count(lambda c: c & LATER and c & 12 != BLANK),
            "truncated": count(lambda c: c & 12 == CUT and not c & LATER),
            "illegal": sum(pair not in LEGAL for pair in zip(kinds, kinds[1:])),
            "cost": cost,
            "audit": audit,
        }


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from `prepared` rows."""
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now = None, None
        for batch in batches:
            ids, rest = batch.column(0), [batch.column(k).to_pylist() for k in (1, 2, 3)]
            done = []
            for lo, hi in _runs(ids):
                if now is None or ids[lo] != name:
                    done += [(name, now)] if now else []
                    name, now = ids[lo], _Open()
                now.add(*[c[lo:hi] for c in rest])
            yield table(done, ids.type)
        if now:
            yield table([(name, now)], name.type)

    def table(done: list, of: pa.DataType) -> pa.RecordBatch:
        records = [now.record() for _, now in done]
        numbers = [pa.array([r[c] for r in records], pa.int64()) for c in COUNTS]
        return pa.RecordBatch.from_arrays([pa.array([n.as_py() for n, _ in done], of), *numbers, pa.array([r["audit"] for r in records], pa.string())], ["conv_id", *COUNTS, "audit"])

    ordered = coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return ordered.mapInArrow(audit, f"conv_id {kind}, {', '.join(c + ' long' for c in COUNTS)}, audit string")


def _with_letters(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's record, then its rows in order."""
    record = F.struct(*COUNTS, "audit")
    texts = rows.where(F.col("digest").isNotNull()).select("conv_id", F.lit(1).alias("at"), "turn", "digest", "role", "text", F.lit(None).cast(audits.select(record.alias("r")).schema["r"].dataType).alias("record"))
    heads = audits.select("conv_id", F.lit(0).alias("at"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "digest", "role", "text")], record.alias("record"))
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "turn", "digest").select("conv_id", "record", "role", "text")


class _Edit:
    """Turns of one conversation as its letters say."""

    def __init__(self, record: dict):
        self.record, self.letters, self.at, self.state = record, record["audit"], 0, 0
        self.hash, self.turns = hashlib.sha256(), 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.letters.startswith("I", self.at):
            self.at += 1
            yield "I", self._expected(), ""

    def _expected(self) -> str:
        self.state = _TURN[self.state]
        return "assistant" if self.state == 3 else "user"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of what stands here after repair."""
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            yield letter, self._expected(), text
        elif letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield letter, role, text

    def hashed(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.hash.update(f"{chr(10) * bool(self.turns)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.turns += 1


def repaired(convs: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, place, edit, role, text), place counting from 1."""
    rows = prepared(convs)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now, of = None, None, None
        for batch in batches:
            of = batch.schema.field(0).type
            out = []
            for name_, record, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if record is not None:
                    out += put(name, now, now.inserted()) if now else []
                    name, now = name_, _Edit(record)
                else:
                    out += put(name, now, now.row(role, text))
            yield table(out, of)
        if now:
            yield table(put(name, now, now.inserted()), of)

    def put(name, now: _Edit, turns: Iterator) -> list:
        out = []
        for turn in turns:
            now.turns += 1
            out.append((name, now.turns, *turn))
        return out

    def table(out: list, of: pa.DataType) -> pa.RecordBatch:
        kinds = (of, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "place", "edit", "role", "text"])

    return _with_letters(rows, audited(rows)).mapInArrow(edit, f"conv_id {kind}, place long, edit string, role string, text string")


def digested(rows: DataFrame) -> DataFrame:
    """The audit of `prepared` rows with repaired_sha256, the digest of the repaired turns."""
    audits = audited(rows)
    names = audits.columns

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now, of = None, None, None
        for batch in batches:
            of = batch.schema.field(0).type
            done = []
            for name_, record, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if record is not None:
                    done += [(name, now)] if now else []
                    name, now = name_, _Edit(record)
                else:
                    now.hashed(now.row(role, text))
            yield table(done, of)
        if now:
            yield table([(name, now)], of)

    def table(done: list, of: pa.DataType) -> pa.RecordBatch:
        for _, now in done:
            now.hashed(now.inserted())
        columns = [pa.array([n for n, _ in done], of), *[pa.array([now.record[c] for _, now in done], pa.int64()) for c in COUNTS]]
        columns += [pa.array([now.record["audit"] for _, now in done], pa.string()), pa.array([now.hash.hexdigest() for _, now in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*names, "repaired_sha256"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audits.schema)
    return _with_letters(rows, audits).mapInArrow(digest, f"{fields}, repaired_sha256 string")


def damaged(convs: DataFrame) -> DataFrame:
    """`prepared` rows after the query's faults, chosen by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = convs.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1))))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault", copies.alias("copy"))
    return prepared(hurt, F.col("fault") != 0)


def query(convs: DataFrame) -> DataFrame:
    """The digest of op13: a row for each conversation of the table, after the query's damage."""
    return digested(damaged(convs))


def _oracle() -> str:
    """The same result in SQL, for tables without two unlike rows of one turn.

    Paths to the four states go on row by row, each the least by cost and letters.
    """
    far = "struct_pack(c := 1000000000::BIGINT, l := '', t := []::VARCHAR[])"
    go = lambda p, cost, letter, turn="": f"struct_pack(c := {p}.c + {cost}, l := {p}.l || '{letter}', t := {p}.t || {f'[{turn}]' if turn else '[]::VARCHAR[]'})"
    least = lambda *paths: f"list_sort([{', '.join(paths)}])[1]"
    kept = lambda p, i: f"CASE WHEN i = '{i}' AND stays THEN {go(p, 'cut', 'K', 'line')} ELSE {far} END"
    named = lambda p, role: f"CASE WHEN stays THEN {go(p, '2 + cut', 'R', f"'{role}:' || txt")} ELSE {far} END"
    onto = {2: ("u", "user", (0, 1, 3)), 3: ("a", "assistant", (2,))}
    ways = {0: [], 1: [kept("s0", "s")]} | {q: [f(f"s{p}", x) for p in ps for f, x in ((kept, i), (named, role))] for q, (i, role, ps) in onto.items()}
    over = ", ".join(f"{least(go(f's{q}', 3, 'D'), *ways[q])} AS s{q}" for q in range(4))
    user = least("s2", *[go(f"s{p}", 2, "I", "'user:'") for p in (0, 1, 3)])
    closed = lambda source, keys: f"SELECT {keys}, s0, s1, s2, {least('s3', go('s2', 2, 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM (SELECT * REPLACE ({user} AS s2) FROM ({source}))"
    begin = f"SELECT c, 0::BIGINT AS pos, struct_pack(c := 0::BIGINT, l := '', t := []::VARCHAR[]) AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM convs"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
WITH RECURSIVE a AS (SELECT conv_id, coalesce('s' || conv_id::VARCHAR, 't') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, {crc_sql(key)} % 20 AS f FROM conversations),
convs AS (SELECT c, any_value(conv_id) AS conv_id FROM a GROUP BY c),
b AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(txt, '{"".join(STOPS)}', '') ELSE txt END AS txt, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM a WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST) AS pos, rtrim(txt, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role || ':' || txt AS line, left(role, 1) AS i FROM b),
q AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY c, role, txt ORDER BY pos) > 1 AS again, lag(i) OVER (PARTITION BY c ORDER BY pos) || i AS pair FROM o),
g AS (SELECT *, NOT blank AND NOT again AS stays, (NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?'))::BIGINT AS cut FROM q),
n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (again)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
  count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(pos) AS rows FROM g GROUP BY c),
r AS ({closed(begin, "c, pos")} UNION ALL {closed(f"SELECT r.c, g.pos, {over} FROM r JOIN g ON r.c = g.c AND g.pos = r.pos + 1", "c, pos")}),
w AS (SELECT convs.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, {least("s0", "s3")} AS p
  FROM convs LEFT JOIN n USING (c) JOIN r ON r.c = convs.c AND r.pos = coalesce(n.rows, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, p.c AS cost, p.l AS audit, sha256(array_to_string(p.t, chr(10))) AS repaired_sha256 FROM w
"""


ORACLE = _oracle()
