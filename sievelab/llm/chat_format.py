"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; an array aggregation walks along them, gives each the mark that
opens a new turn or, after a turn of the same role, that of a further part, and so merges adjacent turns of one role; the
pieces are concatenated:

    ### User: first text</turn>
    ### Assistant: one text</part>the next text of the same role</turn>

Control strings inside texts are escaped and can be restored: ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h``,
``</`` becomes ``\\l`` and, in roles, ``: `` becomes ``\\c``. So no text holds a mark. ``loss_spans`` are the
places (from 0, code points) of assistant texts in the formatted string, marks left out.

Defined results: null texts and roles are empty; null turns come first; equal turns are ordered by role and text,
repeated rows stay repeated; rows with a null conversation id form one conversation; an empty table gives an empty
table; extra columns are left out. A conversation is one output row, so it must fit in one, however it is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import let, pick

TURN_END = "</turn>\n"
PART_END = "</part>"
HEAD = "### "
#: Turns that one array aggregation merges; its arrays grow step by step, so long conversations go through several of them.
CHUNK = 256
SPANS = "array<struct<start:bigint,length:bigint>>"
#: Roles with a capital in the template; others are written with "=" in front.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
TEXT_ESCAPES = (("###", "\\h"), ("</", "\\l"))
ROLE_ESCAPES = TEXT_ESCAPES + ((": ", "\\c"),)


def escape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), escapes, out)


def unescape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    """Pairs of backslashes are cut out first, from the left, so what follows each other backslash is its code."""

    def codes(piece: Column) -> Column:
        return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), escapes, piece)

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), codes), "\\")


def _role_name(role: Column) -> Column:
    out = F.concat(F.lit("="), escape(role, ROLE_ESCAPES))
    for key, name in ROLES.items():
        out = F.when(role == key, name).otherwise(out)
    return out


def _role_of(name: Column) -> Column:
    out = unescape(F.substring(name, 2, 1 << 30), ROLE_ESCAPES)
    for key, shown in ROLES.items():
        out = F.when(name == shown, key).otherwise(out)
    return out


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_merged, formatted, loss_spans (start, length)."""
    rows = pick(
        turns,
        conv_id=conv_col,
        turn=turn_col,
        role=F.coalesce(F.col(f"`{role_col}`"), F.lit("")),
        text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
    )
    turn = F.struct("turn", "role", "text")
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("shown")))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("shown") - 1) / CHUNK).cast("int")),
        lambda c: _merged(F.slice("shown", c * CHUNK + 1, CHUNK), F.get("shown", c * CHUNK - 1)["role"]),
    )
    # each chunk's spans begin at 0; the lengths of the chunks before it are added
    spans = F.aggregate(
        "chunks",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("lists")),
        lambda acc, c: F.struct(
            (acc["at"] + c["at"]).alias("at"),
            F.concat(acc["lists"], F.array(F.transform(c["spans"], lambda s: _span(s["start"] + acc["at"], s["length"])))).alias("lists"),
        ),
        lambda acc: F.flatten(acc["lists"]),
    )
    pieces = F.flatten(F.transform("chunks", lambda c: c["pieces"]))
    return (
        sorted_turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), shown.alias("shown"))
        .select("conv_id", "n_turns", chunks.alias("chunks"))
        .select(
            "conv_id",
            "n_turns",
            F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["merged"]).alias("n_merged"),
            F.concat(F.array_join(pieces, ""), F.lit(TURN_END)).alias("formatted"),
            spans.alias("loss_spans"),
        )
    )


def _span(start: Column, length: Column) -> Column:
    return F.struct(start.alias("start"), length.alias("length"))


def _merged(turns: Column, before: Column) -> Column:
    """Neighbours of one role merged: the pieces to concatenate, how many turns open, the length and the loss spans, from
    (role, shown) in order and the role before the first one (null: none, so the conversation begins here)."""

    def step(acc: Column, t: Column) -> Column:
        same = acc["role"].eqNullSafe(t["role"])
        head = F.concat(F.lit(HEAD), _role_name(t["role"]), F.lit(": "))
        lead = F.when(same, F.lit(PART_END)).when(acc["role"].isNull(), head).otherwise(F.concat(F.lit(TURN_END), head))

        def add(lead: Column) -> Column:
            start = acc["at"] + F.length(lead)
            size = F.length(t["shown"]).cast("long")
            return F.struct(
                t["role"].alias("role"),
                (start + size).alias("at"),
                (acc["merged"] + F.when(same, 0).otherwise(1)).alias("merged"),
                F.concat(acc["pieces"], F.array(F.concat(lead, t["shown"]))).alias("pieces"),
                F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(_span(start, size)))).otherwise(acc["spans"]).alias("spans"),
            )

        return let(lead, add)

    zero = F.struct(
        before.alias("role"),
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("merged"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast(SPANS).alias("spans"),
    )
    return F.aggregate(turns, zero, step)


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The turns back from ``formatted`` alone: conv_id, turns (role, text), and the texts under ``loss_spans``."""
    bodies = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    parts = F.transform(
        bodies,
        lambda b: let(
            F.locate(": ", b),
            lambda at: F.transform(
                F.split(F.substring(b, at + 2, F.length(b)), "</part>"),
                lambda t: F.struct(
                    _role_of(F.substring(b, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        ),
    )
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select("conv_id", "formatted", F.flatten(parts).alias("turns"), masked.alias("loss_texts"))
