"""Chat formatting: a finite-state machine over roles and a declarative template, in native expressions only.

A template gives each role its opening and closing mark, whether its text bears loss, and the moves of the machine:
from each state, which role leads to which state, and which states may end a conversation. Conversations that break
the turn order are formatted too; `valid` and `bad_turn` (the first turn without a move, -1 if only the end is wrong)
say so.

Texts are escaped so that no mark can occur in them: the character that starts every mark is written as the escape
character and a letter, and so is the escape character itself. A reader that splits at the closing marks and undoes
the escapes gets every text back.

Defined results: a null text is an empty one; a null or unknown role is written under the template's `other` mark, its
name escaped as the text's first line, and breaks the order; rows of equal turn are ordered by role and text, nulls
first; rows of a null conversation id form a conversation; an empty table gives an empty one; other columns are not read,
whatever their names. A conversation is one row, as its formatted text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import has_columns, let

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """opening: role to opening mark, which is LEAD, a name and ">"; closing closes every turn."""

    opening: dict[str, str]
    closing: str
    other: str
    loss: frozenset[str]
    start: str
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    ends: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        marks = [*self.opening.values(), self.closing, self.other]
        if any(not m.startswith(LEAD) or not m.endswith(">") or LEAD in m[1:] or ">" in m[:-1] or ESCAPE in m for m in marks) or len(set(marks)) != len(marks):
            raise ValueError(f"marks must differ and be {LEAD}, a name and >")


LEAD = "<"
DEFAULT = Template(
    opening={"system": "<system>", "user": "<user>", "assistant": "<assistant>"},
    closing="</turn>",
    other="<other>",
    loss=frozenset({"assistant"}),
    start="start",
    moves={
        ("start", "system"): "primed",
        ("start", "user"): "asked",
        ("primed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    ends=frozenset({"answered"}),
)


def escape(text: Column) -> Column:
    """Text in which LEAD can't occur; every ESCAPE is followed by b (for itself) or l (for LEAD)."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(LEAD), F.lit(ESCAPE + "l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "l"), F.lit(LEAD)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def _segments(turns: Column, t: Template) -> Column:
    """array<struct<role, text, loss>> in order: opening mark, escaped text, closing mark for each turn."""

    def one(x: Column) -> Column:
        known = x["role"].isin(*t.opening)
        opening = F.lit(t.other)
        for role, mark in t.opening.items():
            opening = F.when(x["role"] == role, F.lit(mark)).otherwise(opening)
        named = F.when(F.coalesce(known, F.lit(False)), escape(x["text"])).otherwise(
            F.concat(F.when(x["role"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.replace(escape(x["role"]), F.lit("\n"), F.lit(ESCAPE + "n")))), F.lit("\n"), escape(x["text"]))
        )
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(opening, F.lit(False)), seg(named, F.coalesce(x["role"].isin(*t.loss), F.lit(False))), seg(F.lit(t.closing), F.lit(False)))

    return F.flatten(F.transform(turns, one))


def _machine(turns: Column, t: Template) -> Column:
    """struct<state, at, bad>: the machine after all turns; bad is the first turn's index without a move, else null."""
    moves = F.create_map(*[F.lit(v) for (state, role), to in t.moves.items() for v in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        return let(
            F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), F.coalesce(x["role"], F.lit("")))),
            lambda to: F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(to.isNull(), s["at"])).alias("bad")),
        )

    return F.aggregate(turns, begin, step)


def format_chats(chats: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted (string), segments array<struct<text, loss>>, valid, bad_turn."""
    has_columns(chats, conv_id, turn, role, text)
    rows = chats.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("row"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    made = told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _segments(F.col("turns"), template).alias("segments"), _machine(F.col("turns"), template).alias("end"))
    valid = F.col("end.bad").isNull() & F.col("end.state").isin(*template.ends)
    bad = F.when(~valid, F.coalesce(F.col("end.bad"), F.lit(-1)))
    return made.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", valid.alias("valid"), bad.alias("bad_turn"))


def loss_mask(segments: Column) -> Column:
    """array<struct<start, length>>: the spans of the formatted text (in code points) that bear loss."""
    spans = F.aggregate(
        segments,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, s: let(
            F.char_length(s["text"]),
            lambda n: F.struct((a["at"] + n).alias("at"), F.when(s["loss"] & (n > 0), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), n.alias("length"))))).otherwise(a["spans"]).alias("spans")),
        ),
    )
    return spans["spans"]


def read_chats(formatted: DataFrame, template: Template = DEFAULT, text: str = "formatted") -> DataFrame:
    """formatted plus turns array<struct<role, text>>, parsed from the text alone."""
    has_columns(formatted, text)
    pieces = F.split(F.col(text), r"\Q" + template.closing + r"\E")
    parts = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parse(s: Column) -> Column:
        mark = F.concat(F.substring_index(s, ">", 1), F.lit(">"))
        body = F.substring(s, F.char_length(mark) + 1, F.char_length(s))
        role = F.lit(None).cast("string")
        for r, m in template.opening.items():
            role = F.when(mark == m, F.lit(r)).otherwise(role)
        name = F.substring_index(body, "\n", 1)
        other = F.when(F.startswith(name, F.lit("=")), unescape(F.replace(F.substring(name, F.lit(2), F.char_length(name)), F.lit(ESCAPE + "n"), F.lit("\n"))))
        rest = F.substring(body, F.char_length(name) + 2, F.char_length(body))
        strange = mark == template.other
        return F.struct(F.when(strange, other).otherwise(role).alias("role"), F.when(strange, unescape(rest)).otherwise(unescape(body)).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, parse))
