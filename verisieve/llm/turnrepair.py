"""Repair of conversation structure by the cheapest edits of their turns.

A repaired conversation is empty or has an optional system turn and then user and assistant turns
in pairs, told by the first letter of the role. Edits: keep a turn (0), give it the role user or
assistant (2), delete it (3, required for blank and repeated turns), insert an empty user or
assistant turn (2); a truncated turn that is not deleted adds 1.

The retained turns, kept or reroled, are chosen by dynamic programming. A state is the role letter
of the last retained turn (or none yet). Whatever lies between two retained turns is deleted, so
its price is a difference of prefix sums, and a state only carries the running minimum of what it
cost so far with all deletions since; the pair of role letters says how many turns must be
inserted between. Of edits of one cost the ASCII-least list of initials (D, I, K, R) counts. At
any turn no state's list is the beginning of another's, so a rank for each state, renewed turn by
turn, compares them without holding them.

A conversation's turns are streamed through one task in order. Choices are held back only until
the paths of all states that can still win have met (a state more than ``FAR`` dearer than the
cheapest cannot), then they are final and go out; so a conversation of any length takes the memory
of the turns in doubt and of its list of initials. Repeats are found by a window that spills.

Turns are ordered by turn (nulls first), ties by role and text. A null role or text is one space.
A null conversation id is a conversation. An empty table gives no rows; other columns are ignored,
clashing names included. A conversation without turns after ``damaged`` has zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisieve.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert between a state and the next retained turn's letter; a system turn only comes first.
BETWEEN = {NONE: {SYSTEM: (), USER: (), ASSISTANT: (USER,)}, SYSTEM: {USER: (), ASSISTANT: (USER,)}, USER: {USER: (ASSISTANT,), ASSISTANT: ()}, ASSISTANT: {USER: (), ASSISTANT: (USER,)}}
AFTER = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: What a dearer state can save on a cheaper one later: a system turn (3) and a pair's insert (2).
FAR = 5


@dataclass
class Turn:
    turn: int | None
    role: str
    text: str
    fault: str = ""


@dataclass
class Edit:
    action: str
    role: str
    text: str
    source: Turn | None


@dataclass
class Repair:
    """The edits of one conversation, fed turn by turn; ``settled`` gives those that are final."""

    cost: dict[int, int] = field(default_factory=lambda: {NONE: 0})
    rank: dict[int, int] = field(default_factory=lambda: {NONE: 0})
    held: list[tuple[Turn, dict[int, tuple[int, str]]]] = field(default_factory=list)
    check_at: int = 256

    def add(self, turn: Turn) -> None:
        options: dict[int, tuple[int, int, str, int]] = {}

        def offer(to: int, cost: int, came: int, edits: str) -> None:
            new = (cost, self.rank[came], edits, came)
            if to not in options or new < options[to]:
                options[to] = new

        kept = STATE.get(turn.role[:1])
        extra = TRUNCATED if turn.fault == "truncated" else 0
        for came, cost in self.cost.items():
            offer(came, cost + DELETE, came, "D")
            if turn.fault in ("blank", "duplicate"):
                continue
            for to, inserts in BETWEEN[came].items():
                paid, before = cost + extra + INSERT * len(inserts), "I" * len(inserts)
                if to == kept:
                    offer(to, paid, came, before + "K")
                if to != SYSTEM:
                    offer(to, paid + REROLE, came, before + "R")
        least = min(o[0] for o in options.values())
        alive = {to: o for to, o in options.items() if o[0] <= least + FAR}
        self.cost = {to: o[0] for to, o in alive.items()}
        self.rank = {to: r for r, to in enumerate(sorted(alive, key=lambda to: alive[to][1:3]))}
        self.held.append((turn, {to: (o[3], o[2]) for to, o in alive.items()}))

    def settled(self) -> list[Edit]:
        """Edits of held turns that every state still alive agrees on."""
        if len(self.held) < self.check_at:
            return []
        states, at = set(self.cost), len(self.held)
        while at and len(states) > 1:
            at -= 1
            states = {self.held[at][1][s][0] for s in states}
        out = self._path(states.pop(), at) if at else []
        self.held = self.held[at:]
        self.check_at = max(256, 2 * len(self.held))
        return out

    def close(self) -> tuple[int, list[Edit]]:
        """The cost of all edits, and those not given yet."""
        ends = [(cost + INSERT * len(AFTER[s]), self.rank[s], "I" * len(AFTER[s]), s) for s, cost in self.cost.items()]
        cost, _, _, state = min(ends)
        return cost, [*self._path(state, len(self.held)), *(Edit("I", ROLE[r], "", None) for r in AFTER[state])]

    def _path(self, state: int, end: int) -> list[Edit]:
        """Edits of the first ``end`` held turns on the way to ``state``."""
        out: list[Edit] = []
        for turn, choices in reversed(self.held[:end]):
            came, edits = choices[state]
            action = edits[-1]
            out.append(Edit(action, ROLE[state] if action == "R" else turn.role, turn.text, turn))
            if action != "D":
                out += [Edit("I", ROLE[r], "", None) for r in reversed(BETWEEN[came][state])]
            state = came
        return out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by the CRC of ``conv_id:turn`` modulo 20: 0 drops a turn
    (it stays with ``copies`` 0), 1 empties its text, 2 takes ends of sentences out, 3 repeats it, 4
    makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(key) % 20
    role, text = _filled("role"), _filled("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _sorted(rows: DataFrame, copies_col: str | None) -> DataFrame:
    """A conversation's turns together and in order, with copies as rows of their own and repeats
    told. One exchange, by conversation: the window's keys begin with it."""
    copies = F.lit(1) if copies_col is None else F.col(copies_col).cast("int")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"), copies.alias("copies"))
    told = plain.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).withColumn("present", F.col("copies") > 0).drop("copies", "copy")
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return told.repartition(n, "conv_id").withColumn("repeated", F.row_number().over(same) > 1).sortWithinPartitions("conv_id", "turn", "role", "text", "repeated")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn | None]]:
    """Conversation id and turn; no turn for rows that only say that the conversation exists."""
    for b in batches:
        for conv, turn, role, text, present, repeated in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "repeated")), strict=True):
            if not present:
                yield conv, None
                continue
            said = text.rstrip(SPACE)
            fault = "blank" if not said else "duplicate" if repeated else "truncated" if said[-1] not in ".!?" else ""
            yield conv, Turn(turn, role, text, fault)


class Digest:
    """What is counted and hashed of one conversation while its turns and edits pass."""

    def __init__(self, conv: int | None):
        self.conv, self.counts = conv, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last, self.distinct, self.before = 0, None, None, 0, None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def turn(self, t: Turn) -> None:
        if t.fault:
            self.counts[t.fault] += 1
        if self.before is not None and self.before + t.role[:1] not in LEGAL:
            self.illegal += 1
        self.before = t.role[:1]
        if t.turn is not None:
            self.distinct += t.turn != self.last
            self.first = t.turn if self.first is None else self.first
            self.last = t.turn

    def edits(self, edits: list[Edit]) -> None:
        self.audit.append("".join(e.action for e in edits))
        for e in edits:
            if e.action != "D":
                self.hash.update(("\n" * self.begun + f"{e.role}:{e.text}").encode())
                self.begun = True

    def row(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.conv, gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


DIGEST = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
EDITS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("action", pa.string()), ("turn", pa.int64()), ("fault", pa.string()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string())])
AS_DDL = {pa.int64(): "long", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {AS_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def repair_edits(conversations: DataFrame, copies_col: str | None = None) -> DataFrame:
    """One row for each edit, in order: what was done, and the repaired role and text (those that
    were, for a deleted turn). An inserted turn has no turn, fault and old role. ``copies_col`` says
    how often a row counts; one of 0 only says that there is such a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, repair, at = None, None, 0

        def put(edits: list[Edit]) -> None:
            nonlocal at
            for e in edits:
                s = e.source
                rows.append((conv, at, e.action, s and s.turn, s and s.fault, s and s.role, e.role, e.text))
                at += 1

        for key, turn in _turns(batches):
            if repair is None or key != conv:
                if repair is not None:
                    put(repair.close()[1])
                conv, repair, at = key, Repair(), 0
            if turn is not None:
                repair.add(turn)
                put(repair.settled())
            if len(rows) >= 2000:
                yield _batch(rows, EDITS)
                rows.clear()
        if repair is not None:
            put(repair.close()[1])
        if rows:
            yield _batch(rows, EDITS)

    return _sorted(conversations, copies_col).mapInArrow(run, _ddl(EDITS))


def repair_digest(conversations: DataFrame, copies_col: str | None = None) -> DataFrame:
    """One row for each conversation: faults, cost and list of its edits, hash of what is left.
    ``copies_col`` is as for ``repair_edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        digest, repair = None, Repair()

        def close() -> None:
            cost, edits = repair.close()
            digest.edits(edits)
            rows.append(digest.row(cost))

        for key, turn in _turns(batches):
            if digest is None or key != digest.conv:
                if digest is not None:
                    close()
                digest, repair = Digest(key), Repair()
            if turn is not None:
                digest.turn(turn)
                repair.add(turn)
                digest.edits(repair.settled())
            if len(rows) >= 2000:
                yield _batch(rows, DIGEST)
                rows.clear()
        if digest is not None:
            close()
        if rows:
            yield _batch(rows, DIGEST)

    return _sorted(conversations, copies_col).mapInArrow(run, _ddl(DIGEST))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "copies")


def _op12_sql() -> str:
    """The same edits with whole lists of initials and whole repaired texts carried along, turn by turn."""
    states = {"n": "NONE", "s": "SYSTEM", "u": "USER", "a": "ASSISTANT"}
    inserts = {("n", "s"): [], ("n", "u"): [], ("n", "a"): ["user"], ("s", "u"): [], ("s", "a"): ["user"], ("u", "u"): ["assistant"], ("u", "a"): [], ("a", "u"): [], ("a", "a"): ["user"]}

    def step(to: str) -> str:
        found = [f"CASE WHEN w.{to} IS NOT NULL THEN {{'cost': w.{to}.cost + 3, 'audit': w.{to}.audit || 'D', 'made': w.{to}.made}} END"]
        for (came, goes), new in inserts.items():
            if goes != to:
                continue
            paid, letters = f"w.{came}.cost + {2 * len(new)} + d.cut", "I" * len(new)
            made = f"w.{came}.made || [{', '.join(repr(r + ':') for r in new)}]" if new else f"w.{came}.made"
            ok = f"NOT d.gone AND w.{came} IS NOT NULL"
            found.append(f"CASE WHEN {ok} AND d.letter = '{to}' THEN {{'cost': {paid}, 'audit': w.{came}.audit || '{letters}K', 'made': {made} || [d.role || ':' || d.text]}} END")
            if to != "s":
                found.append(f"CASE WHEN {ok} THEN {{'cost': {paid} + 2, 'audit': w.{came}.audit || '{letters}R', 'made': {made} || ['{'user' if to == 'u' else 'assistant'}:' || d.text]}} END")
        return f"list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)) AS {to}"

    ends = {"n": "w.n", "s": "{'cost': w.s.cost + 4, 'audit': w.s.audit || 'II', 'made': w.s.made || ['user:', 'assistant:']}", "u": "{'cost': w.u.cost + 2, 'audit': w.u.audit || 'I', 'made': w.u.made || ['assistant:']}", "a": "w.a"}
    ended = ", ".join(f"CASE WHEN w.{s} IS NOT NULL THEN {e} END" for s, e in ends.items())
    kind = "STRUCT(cost BIGINT, audit VARCHAR, made VARCHAR[])"
    return rf"""WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), hit AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(ch) AS BIGINT) FOR ch IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc
), damaged AS MATERIALIZED (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE h WHEN 3 THEN 2 ELSE 1 END) WHERE h <> 0
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS letter FROM damaged
), told AS MATERIALIZED (
  SELECT *, said = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(said, 1) NOT IN ('.', '!', '?') AS open_end,
    lag(letter) OVER (PARTITION BY conv_id ORDER BY pos) || letter NOT IN ('su', 'ua', 'au') AS bad FROM numbered
), d AS MATERIALIZED (
  SELECT *, blank OR again AS gone, CASE WHEN open_end THEN 1 ELSE 0 END AS cut FROM told
), ids AS MATERIALIZED (
  SELECT c.conv_id, count(d.pos) AS turns, coalesce(max(d.turn) - min(d.turn) + 1 - count(DISTINCT d.turn), 0) AS gaps,
    count(*) FILTER (d.blank) AS blank, count(*) FILTER (NOT d.blank AND again) AS duplicate, count(*) FILTER (NOT d.blank AND NOT again AND open_end) AS truncated, count(*) FILTER (bad) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN d ON c.conv_id IS NOT DISTINCT FROM d.conv_id GROUP BY c.conv_id
), w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, CAST({{'cost': 0, 'audit': '', 'made': []}} AS {kind}) AS n, CAST(NULL AS {kind}) AS s, CAST(NULL AS {kind}) AS u, CAST(NULL AS {kind}) AS a FROM ids
  UNION ALL
  SELECT w.conv_id, d.pos, {', '.join(step(s) for s in states)}
  FROM w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.pos = w.pos + 1
), best AS (
  SELECT w.conv_id, list_min(list_filter([{ended}], lambda x: x IS NOT NULL)) AS b FROM w JOIN ids ON ids.conv_id IS NOT DISTINCT FROM w.conv_id AND ids.turns = w.pos
)
SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(array_to_string(b.made, chr(10))) AS repaired_sha256
FROM ids JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id"""


OP12_SQL = _op12_sql()
