"""Chat formatting with Spark expressions.

The turns of a conversation are collected as structs and sorted; runs of turns of one role become one block, whose
parts stay apart by a mark; blocks are concatenated. Control strings inside texts are escaped by a backslash after
their first character (one more than they had), which ``parse_chat`` takes away again. ``segments`` is the formatted
text in pieces, each with a flag that says whether the loss is taken on it: the assistant's texts and nothing else.

Defined results: a null text or role is the empty string; turns are sorted by turn (nulls first), then role, then
text, and repeated rows are repeated turns; roles other than system, user and assistant keep their names in the output;
a null conv_id is a conversation like another; an empty table gives an empty result; extra columns are ignored. One
conversation is one row of the result, so it is the unit of memory, as in any format that puts it in one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, SYSTEM, ASSISTANT, OTHER = ("[INST]", "[/INST]"), ("<<SYS>>", "<</SYS>>"), ("<s>", "</s>"), ("[ROLE]", "[END]")
NAMED, NEXT = "[/ROLE]", "[SEP]"
CONTROLS = (*USER, *SYSTEM, *ASSISTANT, *OTHER, NAMED, NEXT)
RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
ESCAPE = (rf"([<\[])(\\*)(?={RESTS})", r"$1\\$2")
UNESCAPE = (rf"([<\[])\\(\\*)(?={RESTS})", r"$1$2")
BLOCK = "(?s)(?:" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in (SYSTEM, USER, ASSISTANT, OTHER)) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _by_role(role: Column, k: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role), F.lit(NAMED)) if k == 0 else F.lit(OTHER[1])
    return F.when(role == "user", USER[k]).when(role == "assistant", ASSISTANT[k]).when(role == "system", SYSTEM[k]).otherwise(other)


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, blocks (role, texts: adjacent turns of one role), segments (text, loss), formatted."""
    blank = F.lit("")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    n = F.size("t")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[F.greatest(i - 1, F.lit(0))]["role"]))
    runs = sorted_turns.select("conv_id", "t", begins.alias("begins"))
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("t"))
    blocks = F.transform(
        "begins",
        lambda i, k: F.struct(F.col("t")[i]["role"].alias("role"), F.transform(F.slice("t", i + 1, end(k) - i), lambda x: x["text"]).alias("texts")),
    )
    runs = runs.select("conv_id", blocks.alias("blocks"))

    def segments(b: Column) -> Column:
        mark = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("loss")))
        parts = F.transform(
            b["texts"],
            lambda x, k: F.array(
                F.struct(F.when(k > 0, NEXT).otherwise("").alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x).alias("text"), (b["role"] == "assistant").alias("loss")),
            ),
        )
        return F.concat(mark(_by_role(b["role"], 0)), F.flatten(parts), mark(_by_role(b["role"], 1)))

    made = runs.select("conv_id", "blocks", F.filter(F.flatten(F.transform("blocks", segments)), lambda s: s["text"] != "").alias("segments"))
    return made.select("conv_id", "blocks", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    blocks = F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(0))

    def inside(b: Column, marks: tuple[str, str]) -> Column:
        return F.substring(b, F.lit(len(marks[0]) + 1), F.length(b) - len(marks[0]) - len(marks[1]))

    def turns(b: Column) -> Column:
        other = b.startswith(OTHER[0])
        role = (
            F.when(other, unescape(F.substring_index(inside(b, OTHER), NAMED, 1)))
            .when(b.startswith(USER[0]), "user")
            .when(b.startswith(SYSTEM[0]), "system")
            .otherwise("assistant")
        )
        named = inside(b, OTHER)
        body = (
            F.when(other, F.substring(named, F.length(F.substring_index(named, NAMED, 1)) + len(NAMED) + 1, F.length(named)))
            .when(b.startswith(USER[0]), inside(b, USER))
            .when(b.startswith(SYSTEM[0]), inside(b, SYSTEM))
            .otherwise(inside(b, ASSISTANT))
        )
        return F.transform(F.split(body, re.escape(NEXT), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
