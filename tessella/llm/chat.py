"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and its text alone is trainable. A turn is written as

    <|im_start|>role(line feed)text<|im_end|>(line feed)

Control strings inside roles and texts are broken by a backslash after their
first character, backslashes are doubled, and a line feed in a role gets a
backslash before it. So every backslash in a formatted text stands before a
character that is meant literally, which is how it is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that chat templates use as control marks.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    name = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(START), name, F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant"
) -> DataFrame:
    """``conv_col``, ``example`` (from 0), ``formatted``, ``loss_start`` and ``loss_end`` (code points, end exclusive).

    One row for each turn of ``target_role``. Turns after a conversation's
    last target make one example more, without trainable text (an empty span
    at its end), so that nothing is lost. Turns are ordered by number, null
    first, and then by role and text; repeated rows are turns of their own.
    Null roles and texts are empty; null conversation ids form one
    conversation. An empty table gives none. Further columns are not looked
    at. All turns of a conversation have to fit one example, as the format
    asks for.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.lit(0).alias("start"),
    )
    whole = turns.groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", lambda t: formatted_turn(t["role"], t["text"]))
    lasts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == target_role) | (i == F.size("turns")))
    placed = whole.select(conv_col, "turns", pieces.alias("pieces")).select(conv_col, "turns", "pieces", F.posexplode(lasts).alias("example", "last"))
    own = F.element_at("turns", F.col("last"))
    size = F.length(escape(own["text"]))
    text = F.array_join(F.slice("pieces", 1, F.col("last")), "")
    out = placed.select(conv_col, "example", text.alias("formatted"), (own["role"] == target_role).alias("_target"), size.alias("_size"))
    end = F.length("formatted") - F.when(F.col("_target"), F.lit(len(END))).otherwise(0)
    return out.select(conv_col, "example", "formatted", (end - F.when(F.col("_target"), F.col("_size")).otherwise(0)).alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*+)\n", 1)
        text = F.substring(p, F.length(name) + F.lit(len(START) + 2), F.length(p))
        return F.struct(unescape(name).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))
