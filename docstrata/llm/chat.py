"""Chat formatting by a finite-state machine over roles.

A template is data: control strings, and moves (state, role, next state, pieces).  A conversation's turns are read in
order; each takes the move of the state that the turns before have led to, and emits that move's pieces as segments of
text with a loss flag.  Moves with state or role ``*`` stand for all that are not named; those that are not ``in_order``
say where the order of turns is broken.  Such a conversation is formatted whole, too, and marked.

Control strings inside texts and role names are written as the escape character and a letter, the escape character
itself as it and ``0``.  No control string has the first character of one, or the escape character, further inside, so
none can arise where texts and marks meet, and a text between two marks can be read back by searching for the marks.

All steps are built-in expressions: one grouping by conversation, then higher-order functions over its turns.  A
conversation becomes one text, so all its rows must fit one row of Spark (2 GB); other conversations do not matter to it.

Cases: null text and role are empty; a role that the template does not name keeps its name in the output; turns are
ordered by turn (null first), then role and text, so equal turn numbers have a defined order and repeated rows are
repeated turns; a null conv_id is a conversation of its own; other columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256  # turns whose moves are gathered in one array before it is added to the others'
ANY = "*"


@dataclass(frozen=True)
class Piece:
    """A mark (one of the control strings), or the turn's ``role`` or ``text``."""

    mark: str = ""
    slot: str = ""
    loss: bool = False


@dataclass(frozen=True)
class Move:
    state: str
    role: str
    to: str
    pieces: tuple[Piece, ...]
    in_order: bool = True


@dataclass(frozen=True)
class Template:
    moves: tuple[Move, ...]
    start: str
    ends: tuple[str, ...]
    escape: str = "\\"

    def __post_init__(self) -> None:
        firsts = {m[0] for m in self.marks}
        if len(self.marks) > 26 or len(self.escape) != 1 or any(c in firsts or c == self.escape for m in self.marks for c in m[1:]) or self.escape in firsts:
            raise ValueError("a control string has the first character of one, or the escape character, inside")
        shapes = {m.pieces for m in self.moves}
        if any(p[-1].slot for p in shapes) or sum(bool(p[0].slot) for p in shapes) > 1:
            raise ValueError("a turn ends with a control string, and all kinds of turns but one begin with one")
        if (ANY, ANY) not in {(m.state, m.role) for m in self.moves}:
            raise ValueError("a move for any state and role is needed")

    @property
    def marks(self) -> list[str]:
        return list(dict.fromkeys(p.mark for m in self.moves for p in m.pieces if p.mark))

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(m.to for m in self.moves)]))

    @property
    def roles(self) -> list[str]:
        return list(dict.fromkeys(m.role for m in self.moves if m.role != ANY))

    def move(self, state: str, role: str) -> int:
        """The number of the first move for a state and role, named ones before those for any."""
        for s, r in ((state, role), (ANY, role), (state, ANY), (ANY, ANY)):
            for i, m in enumerate(self.moves):
                if (m.state, m.role) == (s, r):
                    return i
        raise AssertionError


TEXT, ANSWER, ROLE = Piece(slot="text"), Piece(slot="text", loss=True), Piece(slot="role")
_SYSTEM = (Piece("[SYS]"), TEXT, Piece("[/SYS]"))
_USER = (Piece("[INST]"), TEXT, Piece("[/INST]"))
_ASSISTANT = (ANSWER, Piece("</s>"))
_OTHER = (Piece("[ROLE]"), ROLE, Piece("[/ROLE]"), TEXT, Piece("[/TURN]"))
BEGIN = Piece("<s>")
INSTRUCT = Template(
    moves=(
        Move("start", "system", "primed", (BEGIN, *_SYSTEM)),
        Move("start", "user", "asked", (BEGIN, *_USER)),
        Move("primed", "user", "asked", _USER),
        Move("asked", "assistant", "answered", _ASSISTANT),
        Move("answered", "user", "asked", (BEGIN, *_USER)),
        Move(ANY, "system", "primed", _SYSTEM, in_order=False),
        Move(ANY, "user", "asked", _USER, in_order=False),
        Move(ANY, "assistant", "answered", _ASSISTANT, in_order=False),
        Move(ANY, ANY, "primed", _OTHER, in_order=False),
    ),
    start="start",
    ends=("answered",),
)


def _codes(template: Template) -> list[tuple[str, str]]:
    return [(mark, template.escape + chr(ord("a") + i)) for i, mark in enumerate(template.marks)]


def escaped(text: Column, template: Template = INSTRUCT) -> Column:
    """The text without control strings."""
    first = F.replace(text, F.lit(template.escape), F.lit(template.escape + "0"))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _codes(template), first)


def unescaped(text: Column, template: Template = INSTRUCT) -> Column:
    """The text that ``escaped`` was given."""
    inner = reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), _codes(template), text)
    return F.replace(inner, F.lit(template.escape + "0"), F.lit(template.escape))


def moves_of(roles: Column, template: Template = INSTRUCT) -> Column:
    """The numbers of the moves that an array of roles takes.  Moves are gathered a block at a time, so the work does not
    grow with the square of a conversation's turns."""
    states, names = template.states, template.roles
    table = F.array(*[F.lit(template.move(s, r)) for s in states for r in (*names, ANY)])
    to = F.array(*[F.lit(states.index(m.to)) for m in template.moves])
    role_code = lambda role: F.coalesce(*[F.when(role == r, F.lit(i)) for i, r in enumerate(names)], F.lit(len(names)))
    coded = F.transform(roles, role_code)
    none = F.array().cast("array<int>")

    def step(done: Column, role: Column) -> Column:
        move = F.get(table, done["state"] * (len(names) + 1) + role)
        return F.struct(F.get(to, move).alias("state"), F.array_append(done["moves"], move).alias("moves"))

    def block(done: Column, part: Column) -> Column:
        one = F.aggregate(part, F.struct(done["state"].alias("state"), none.alias("moves")), step)
        # Through an array of one, so that the block is read once for both uses.
        return F.get(F.transform(F.array(one), lambda x: F.struct(x["state"].alias("state"), F.array_append(done["moves"], x["moves"]).alias("moves"))), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(coded) - 1) / BLOCK).cast("int")), lambda i: F.slice(coded, i * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(F.lit(states.index(template.start)).alias("state"), F.array().cast("array<array<int>>").alias("moves"))
    return F.flatten(F.aggregate(parts, begin, block)["moves"])


def formatted(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """rows (conv_id, turn, role, text) to one row a conversation: conv_id, segments (array of text and loss), in_order,
    broken_at (the first turn that is out of order, from 0), complete (in order, and ended in an end state)."""
    own = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    talks = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    talks = talks.withColumn("moves", moves_of(F.col("turns.role"), template))

    def segment(piece: Piece, turn: Column) -> Column:
        text = F.lit(piece.mark) if piece.mark else escaped(turn[piece.slot], template)
        return F.struct(text.alias("text"), F.lit(piece.loss).alias("loss"))

    def emitted(turn: Column, i: Column) -> Column:
        kinds = [F.when(F.get("moves", i) == k, F.array(*[segment(p, turn) for p in m.pieces])) for k, m in enumerate(template.moves)]
        return F.coalesce(*kinds)

    ordered = F.array(*[F.lit(m.in_order) for m in template.moves])
    ended = F.array(*[F.lit(m.to in template.ends) for m in template.moves])
    talks = talks.withColumn("broken_at", F.nullif(F.array_position(F.transform("moves", lambda m: F.get(ordered, m)), False), F.lit(0)) - 1)
    return talks.select(
        "conv_id",
        F.flatten(F.transform("turns", emitted)).alias("segments"),
        F.col("broken_at").isNull().alias("in_order"),
        "broken_at",
        (F.col("broken_at").isNull() & F.get(ended, F.element_at("moves", -1))).alias("complete"),
    )


def text_of(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def loss_of(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def _pattern(pieces: Sequence[Piece]) -> str:
    return "".join(re.escape(p.mark) if p.mark else "(.*?)" for p in pieces)


def turns_of(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text says; a text that is not all turns raises."""
    shapes: dict[tuple[Piece, ...], str] = {}
    for m in template.moves:
        shapes.setdefault(m.pieces, m.role)
    order = sorted(shapes, key=lambda p: (bool(p[0].slot), -sum(bool(x.mark) for x in p)))
    found = F.regexp_extract_all(text, F.lit("(?s)" + "|".join(_pattern(p) for p in order)), F.lit(0))

    def read(turn: Column) -> Column:
        kinds = []
        for pieces in order:
            slots = [p.slot for p in pieces if p.slot]
            part = lambda slot, pieces=pieces, slots=slots: F.regexp_extract(turn, "(?s)^" + _pattern(pieces) + "$", slots.index(slot) + 1)
            role = part("role") if "role" in slots else F.lit(shapes[pieces])
            opening = F.lit(True) if pieces[0].slot else turn.startswith("".join(p.mark for p in _leading(pieces)))
            kinds.append(F.when(opening, F.struct(unescaped(role, template).alias("role"), unescaped(part("text"), template).alias("text"))))
        return F.coalesce(*kinds)

    wrong = F.raise_error(F.lit("the text is not a row of turns")).cast("array<string>")
    whole = F.get(F.transform(F.array(found), lambda f: F.when(F.array_join(f, "") == text, f).otherwise(wrong)), F.lit(0))
    return F.transform(whole, read)


def _leading(pieces: Sequence[Piece]) -> list[Piece]:
    at = next(i for i, p in enumerate(pieces) if p.slot)
    return list(pieces[:at])


PROBE = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when they are read again."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    # Each is a column of its own, so that it is evaluated once and not once for each use.
    out = formatted(rows.unionByName(extra)).withColumn("whole", text_of(F.col("segments"))).withColumn("lost", loss_of(F.col("segments")))
    out = out.withColumn("said", turns_of(F.col("whole")))
    said = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.char_length("whole").cast("long").alias("formatted_chars"), "in_order", F.col("broken_at").cast("long").alias("broken_at"), "complete",
    )


def _oracle() -> str:
    text = f"replace({{0}}, '{INSTRUCT.escape}', '{INSTRUCT.escape}0')"
    for mark, code in _codes(INSTRUCT):
        text = f"replace({text}, '{mark}', '{code}')"
    return f"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
numbered as (select *, row_number() over w as i, lag(role) over w as before from said window w as (partition by conv_id order by turn nulls first, role, text)),
judged as (select *, coalesce((i = 1 and role in ('system', 'user')) or (before in ('system', 'assistant') and role = 'user') or (before not in ('system', 'assistant', 'user') and role = 'user')
    or (before = 'user' and role = 'assistant'), false) as fits,
  case role when 'system' then 11 + case when i = 1 then 3 else 0 end when 'user' then 13 + case when i = 1 or before = 'assistant' then 3 else 0 end when 'assistant' then 4
    else 20 + length({text.format('role')}) end + length({text.format('text')}) as chars from numbered)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, bool_and(fits) as in_order, min(i - 1) filter (not fits) as broken_at, bool_and(fits) and arg_max(role, i) = 'assistant' as complete
from judged group by conv_id"""


QUERIES = {"op13_chat_format": op13_chat_format}
ORACLE = {"op13_chat_format": _oracle()}
