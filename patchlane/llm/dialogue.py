"""Repair of conversation structure: the cheapest edits that leave an optional system turn and pairs of user and assistant.

A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that is no white space ends no sentence). Edits are Keep (0), Rerole to user or assistant (1),
Delete (2; blank and duplicate turns must go) and Insert of an empty user or assistant turn anywhere (5); a truncated turn
that stays costs 5 more. The audit is the edits' initials in order; of equally cheap ones the least in ASCII order. The
edits of an audit fix the repaired turns, as only a kept turn can stand for the system and all others alternate.

A pass over the turns in order keeps the cheapest audit of each of four states (nothing yet, system, user, assistant).
Audits are linked nodes (Edit) that share their prefixes; a node has its ancestors at powers of two and a rolling hash of
its letters. Two equally cheap audits are compared at their first difference, which is found by halving over hashes; letters
before it are then compared up to the node that both share, so a collision of hashes decides nothing. States that cost so
much more than the best one that this could reach whatever they reach are given up, and what all states share is written
out and forgotten, so the nodes held are those of the open end.

Spark deals conversations by their identifier, marks duplicates in the same dealing, and sorts; a task streams its
conversations through the pass, holding one turn at a time. The texts wait in a spooled file (memory, then the task's own
scratch disk), as a turn's fate is known late. A conversation is one stream, as the digest of its repaired text is, but
it is never gathered.

Defined cases: a null role or text is one space; a null turn sorts first; turns of equal number are ordered by role, then
text; a null identifier is a conversation of its own; a conversation without turns (all dropped) has an empty audit; an
empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS, BASE = (1 << 61) - 1, 911382323
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a user or an assistant turn may follow, and where that leads.
BEFORE = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,), "s": (START,)}
LEADS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: From any state all that another one reaches is reached with two insertions and a deletion more.
REACH = 2 * INSERT + DELETE
#: Turns between two writings of what all states share.
SETTLE = 1024
SPOOL_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"


class Edit:
    """An audit's last letter, linked to the audit before it: ups[k] is the node 2^k letters earlier."""

    __slots__ = ("letter", "depth", "hash", "ups")

    def __init__(self, before: Edit | None, letter: str = ""):
        if before is None:
            self.letter, self.depth, self.hash, self.ups = "", 0, 0, []
            return
        self.letter, self.depth = letter, before.depth + 1
        self.hash = (before.hash * BASE + ord(letter)) % MODULUS
        ups, k = [before], 0
        while len(ups[k].ups) > k:
            ups.append(ups[k].ups[k])
            k += 1
        self.ups = ups


def ancestor(node: Edit, depth: int) -> Edit:
    k = len(node.ups) - 1
    while node.depth > depth:
        while node.depth - (1 << k) < depth:
            k -= 1
        node = node.ups[k]
        k = min(k, len(node.ups) - 1)
    return node


def first_difference(a: Edit, b: Edit) -> tuple[Edit, Edit] | None:
    """The nodes of a and b at the first place where their letters differ; none if one is the beginning of the other."""
    depth = min(a.depth, b.depth)
    a, b = ancestor(a, depth), ancestor(b, depth)
    found = None
    if a.hash != b.hash:
        for k in range(len(a.ups) - 1, -1, -1):
            if k < len(a.ups) and a.ups[k].hash != b.ups[k].hash:
                a, b = a.ups[k], b.ups[k]
        found, a, b = (a, b), a.ups[0], b.ups[0]
    while a is not b:  # equal hashes: look whether the letters are, too
        if a.letter != b.letter:
            found = a, b
        a, b = a.ups[0], b.ups[0]
    return found


def earlier(a: Edit, b: Edit) -> bool:
    """Whether a's letters stand before b's in ASCII order."""
    found = first_difference(a, b)
    return a.depth < b.depth if found is None else found[0].letter < found[1].letter


def shared_node(a: Edit, b: Edit) -> Edit:
    """The last node that both have in common."""
    depth = min(a.depth, b.depth)
    a, b = ancestor(a, depth), ancestor(b, depth)
    for k in range(len(a.ups) - 1, -1, -1):
        if k < len(a.ups) and a.ups[k] is not b.ups[k]:
            a, b = a.ups[k], b.ups[k]
    return a if a is b else a.ups[0]


def letters(node: Edit, above: Edit | None = None) -> str:
    """The letters from behind `above` (or the start) to node."""
    out = []
    while node.ups and node is not above:
        out.append(node.letter)
        node = node.ups[0]
    return "".join(reversed(out))


class Audits:
    """The cheapest audit of each state over the turns so far, as (cost, Edit) or None."""

    def __init__(self) -> None:
        self.states: list[tuple[int, Edit] | None] = [(0, Edit(None)), None, None, None]
        self.settled: list[str] = []
        self.turns = 0

    @staticmethod
    def best(options: list[tuple[int, Edit, str]]) -> tuple[int, Edit] | None:
        """Of (cost, audit, letter to follow; none for the audit itself) the cheapest, of these the earliest."""
        if not options:
            return None
        least = min(o[0] for o in options)
        made = [Edit(node, letter) if letter else node for cost, node, letter in options if cost == least]
        first = made[0]
        for other in made[1:]:
            if earlier(other, first):
                first = other
        return least, first

    def insert(self) -> None:
        for role in "ua":
            to = LEADS[role]
            options = [(s[0] + INSERT, s[1], "I") for s in (self.states[k] for k in BEFORE[role]) if s]
            self.states[to] = self.best(([(*self.states[to], "")] if self.states[to] else []) + options)

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        options: list[list] = [[(s[0] + DELETE, s[1], "D")] if s else [] for s in self.states]
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for role, to in LEADS.items():
                for k in BEFORE[role]:
                    s = self.states[k]
                    if s and initial == role:
                        options[to].append((s[0] + KEEP + extra, s[1], "K"))
                    elif s and role != "s":
                        options[to].append((s[0] + REROLE + extra, s[1], "R"))
        made = [self.best(o) for o in options]
        least = min(s[0] for s in made if s)
        self.states = [s if s and s[0] <= least + REACH else None for s in made]
        self.turns += 1
        if self.turns % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Write out the letters that all states share, and begin the nodes anew behind them."""
        ends = [s[1] for s in self.states if s]
        common = ends[0]
        for other in ends[1:]:
            common = shared_node(common, other)
        self.settled.append(letters(common))
        anew = {id(common): Edit(None)}

        def copy(node: Edit) -> Edit:
            path = []
            while id(node) not in anew:
                path.append(node)
                node = node.ups[0]
            made = anew[id(node)]
            for step in reversed(path):
                made = anew[id(step)] = Edit(made, step.letter)
            return made

        self.states = [(s[0], copy(s[1])) if s else None for s in self.states]

    def finish(self) -> tuple[int, str]:
        """Cost and letters of the best audit: no turn at all, or whole pairs."""
        self.insert()
        cost, node = self.best([(*s, "") for s in (self.states[START], self.states[ASSISTANT]) if s])
        return cost, "".join(self.settled) + letters(node)


class Conversation:
    """Figures, audit and waiting texts of one conversation, fed turn by turn."""

    def __init__(self) -> None:
        self.audits, self.file = Audits(), tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:  # turns ascend
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.audits.turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        pickle.dump((role, text), self.file)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of each turn that the audit leaves."""
        self.file.seek(0)
        following = "user"
        for letter in audit:
            role, text = (following, "") if letter == "I" else pickle.load(self.file)
            if letter == "D":
                continue
            if letter == "R":
                role = following
            following = "assistant" if role[:1] == "u" else "user"
            yield letter, role, text


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20) -> DataFrame:
    """Turns with faults made by rule, from the remainder of the checksum of `conv:turn`: 0 dropped (the row stays, marked so),
    1 emptied, 2 without its [.!?], 3 there twice, 4 said by the user. Nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % every
    said = F.coalesce(F.col(text).cast("string"), space)
    made = turns.select(
        F.col(conv).alias(conv), F.col(turn).cast("long").alias(turn), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), space)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text), (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made.drop("copy")


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: str | None) -> DataFrame:
    """conv, turn, role, text, fault ('' for none; null for a dropped row), whole conversations in order within partitions."""
    space, gone = F.lit(" "), F.col(dropped) if dropped else F.lit(False)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"), gone.alias("gone"))
    rows = rows.withColumn("text", F.when(F.col("gone"), "").otherwise(F.col("text"))).repartition("conv")
    same = Window.partitionBy("conv", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    rows = rows.withColumn("seen", F.row_number().over(same))
    fault = F.when(F.col("gone"), None).when(end == "", "blank").when(F.col("seen") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "seen").select("conv", "turn", "role", "text", "fault")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation]]:
    """Whole conversations of ordered rows."""
    held: Conversation | None = None
    name = None
    for batch in batches:
        for conv, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held is None or conv != name:
                if held is not None:
                    yield name, held
                held, name = Conversation(), conv
            if fault is not None:
                held.add(turn, role, text, fault)
    if held is not None:
        yield name, held


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _streamed(turns: DataFrame, fields: list[T.StructField], each, columns: tuple) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    conv = columns[0]
    schema = T.StructType([T.StructField(conv, turns.schema[conv].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((row for name, held in _conversations(batches) for row in each(name, held)), to_arrow_schema(schema))

    return ordered(turns, *columns).mapInArrow(run, schema)


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """A row for each conversation: gaps (turn numbers missing between the least and the largest), blank, duplicate,
    truncated, illegal (neighbours that may not follow each other), cost, audit, and repaired_sha256 (of `role:text` of the
    repaired turns, joined by newlines). Rows where dropped is true only name their conversation."""

    def each(name: object, held: Conversation) -> Iterator[tuple]:
        cost, made = held.audits.finish()
        digest, first = hashlib.sha256(), True
        for _, who, said in held.repaired(made):
            digest.update(f"{'' if first else chr(10)}{who}:{said}".encode())
            first = False
        yield name, held.gaps(), held.blank, held.duplicate, held.truncated, held.illegal, cost, made, digest.hexdigest()

    numbers = [T.StructField(n, T.LongType(), False) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _streamed(turns, [*numbers, T.StructField("audit", T.StringType(), False), T.StructField("repaired_sha256", T.StringType(), False)], each, (conv, turn, role, text, dropped))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """The repaired turns: conv, turn (numbered from 0), role, text and the edit (K, R or I) that made each."""

    def each(name: object, held: Conversation) -> Iterator[tuple]:
        _, made = held.audits.finish()
        for number, (letter, who, said) in enumerate(held.repaired(made)):
            yield name, number, who, said, letter

    fields = [T.StructField(turn, T.LongType(), False), T.StructField(role, T.StringType(), False), T.StructField(text, T.StringType(), False), T.StructField("edit", T.StringType(), False)]
    return _streamed(turns, fields, each, (conv, turn, role, text, dropped))


def _sql() -> str:
    from .spelling import CRC32, CRC_TABLE

    step = lambda s, cost, letter, out="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {out}}}"
    state = lambda k: f"s.st[{k + 1}]"
    said = lambda role: f"chr(10) || {role} || ':' || e.text"
    inserted = lambda to, role: [state(to), *(step(state(k), INSERT, "I", f"chr(10) || '{role}:'") for k in BEFORE[role[0]])]
    allowed = lambda option: f"case when e.must then null else {option} end"

    def options(to: int) -> list[str]:
        made = [step(state(to), DELETE, "D")]
        for initial, role in (("s", ""), ("u", "user"), ("a", "assistant")):
            if LEADS[initial] == to:
                for k in BEFORE[initial]:
                    made.append(f"case when e.ini = '{initial}' and not e.must then {step(state(k), 'e.extra', 'K', said('e.role'))} end")
                    if role:
                        made.append(allowed(step(state(k), f"e.extra + {REROLE}", "R", said(f"'{role}'"))))
        return made

    least = lambda these: f"list_min([{', '.join(these)}])"
    states = lambda new: "[" + ", ".join(new.get(k, state(k)) for k in range(4)) + "]"
    advance = f"""case e.k when 1 then {states({USER: least(inserted(USER, "user"))})} when 2 then {states({ASSISTANT: least(inserted(ASSISTANT, "assistant"))})}
      else {states({k: least(options(k)) for k in range(4)})} end"""
    event = lambda k, st="null": f"{{'k': {k}, 'ini': '', 'role': '', 'text': '', 'must': false, 'extra': 0, 'st': {st}::struct(c bigint, a varchar, o varchar)[]}}"
    start = "[" + ", ".join(f"{{'c': {0 if k == START else 1000000000}, 'a': '', 'o': ''}}" for k in range(4)) + "]"
    return f"""
with recursive {CRC_TABLE},
turns as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations
), kinds as (select name, {CRC32.format(b="list_transform(string_split(name, ''), lambda x: ord(x))::bigint[]")} % 20 as kind from (select distinct name from turns), crc
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from turns join kinds using (name) where kind <> 0
), looked as (
  select *, right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) as tail,
         row_number() over (partition by conv_id, role, text order by turn nulls first) as seen
  from damaged
), placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, seen) as place from looked
), faults as (
  select *, case when tail = '' then 'blank' when seen > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(role[1]) over (partition by conv_id order by place) || role[1] as neighbours
  from placed
), folded as (
  select conv_id, case when max(turn) is null then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (neighbours not in ('su', 'ua', 'au')) as illegal,
         list_reduce(flatten(list([{event(1)}, {event(2)}, {{'k': 3, 'ini': role[1], 'role': role, 'text': text, 'must': fault in ('blank', 'duplicate'), 'extra': case when fault = 'truncated' then {TRUNCATED} else 0 end, 'st': null}}] order by place))
           || [{event(1)}, {event(2)}],
           lambda s, e: {{'k': 0, 'ini': '', 'role': '', 'text': '', 'must': false, 'extra': 0, 'st': {advance}}}, {event(0, start)}).st as st
  from faults group by conv_id
), ended as (select *, list_min([st[{START + 1}], st[{ASSISTANT + 1}]]) as e from folded)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(e.o[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join ended n on c.conv_id is not distinct from n.conv_id
"""


#: What op13 gives on conversations: the same pass as a fold over each conversation's list of turns.
SQL = _sql()
