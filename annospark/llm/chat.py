"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: ``prompt`` holds all
preceding turns and the opening mark of the reply, ``target`` the reply, the
only trainable part, and ``closing`` the end mark.  A conversation that does
not end with an assistant turn gets one more row, of kind ``context``: all its
turns as prompt and nothing trainable, so that no turn is lost.

A turn is written ``### Role: text</turn>`` and a line end.  The characters
that could form a mark are escaped inside roles and texts, reversibly:
backslash as ``\\b``, ``<`` as ``\\l``, ``#`` as ``\\h`` (roles also ``:`` as
``\\c``).

Defined results: null text or role = empty; turns go in order of turn number,
role and text (null turn numbers first; equal rows stay repeated); rows with a
null conversation id form one conversation; a conversation without assistant
turns has its context row alone; an empty table gives an empty table.  The
context of a reply is all turns before it, so the output of one conversation
grows with the square of its turns; that is the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
ASSISTANT = "assistant"


def escaped(c: Column, marks=ESCAPES) -> Column:
    for plain, code in marks:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, marks=ESCAPES) -> Column:
    for plain, code in reversed(marks):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """(conv_id, example, kind, prompt, target, closing): one row per assistant turn, and context rows."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    opening = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct((t["role"] == ASSISTANT).alias("reply"), opening(t).alias("opening"),
                                             escaped(t["text"]).alias("body"))).alias("ts"))
    whole = F.transform("ts", lambda t: F.concat(t["opening"], t["body"], F.lit(CLOSE)))
    # turn k as a reply; one past the last turn as a context row
    replies = F.filter(F.transform("ts", lambda t, k: F.when(t["reply"], k)), lambda k: k.isNotNull())
    tail = F.when(F.element_at("ts", -1)["reply"], F.array().cast("array<int>")).otherwise(F.array(F.size("ts")))
    at = convs.select("conv_id", "ts", whole.alias("whole"),
                      F.posexplode(F.concat(replies, tail)).alias("example", "k"))
    reply = F.get("ts", F.col("k"))
    before = F.array_join(F.slice("whole", F.lit(1), F.col("k")), "")
    is_reply = F.col("k") < F.size("ts")
    return at.select(
        "conv_id", "example", F.when(is_reply, "reply").otherwise("context").alias("kind"),
        F.when(is_reply, F.concat(before, reply["opening"])).otherwise(before).alias("prompt"),
        F.when(is_reply, reply["body"]).otherwise("").alias("target"),
        F.when(is_reply, CLOSE).otherwise("").alias("closing"))


def read_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, trained, formatted): roles and texts of every turn, the trainable texts in
    order, and the formatted conversation, read back from the examples alone."""
    last = F.max_by(F.concat("prompt", "target", "closing"), "example")
    targets = F.array_sort(F.collect_list(F.when(F.col("kind") == "reply", F.struct("example", "target"))))
    convs = examples.groupBy("conv_id").agg(last.alias("formatted"), targets.alias("targets"))
    parts = F.filter(F.split("formatted", F.lit(CLOSE), -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        mark = F.instr(p, AFTER_ROLE)
        role = F.substring(p, F.lit(len(OPEN) + 1), mark - 1 - len(OPEN))
        text = F.substring(p, mark + len(AFTER_ROLE), F.length(p))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    return convs.select("conv_id", F.transform(parts, turn).alias("turns"),
                        F.transform("targets", lambda t: unescaped(t["target"])).alias("trained"), "formatted")
