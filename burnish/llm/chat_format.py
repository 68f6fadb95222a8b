"""Operator 3, chat formatting: one marked-up string for each conversation, built by Spark expressions only.

Rows are collected as structs and sorted by turn; neighbours of one role merge into one block.  The template is

    <|start|>role<|text|>first text<|text|>next text of the same role<|end|>

with <|loss|> in place of <|text|> before texts of trained roles, so the string itself carries the loss mask.  A
control string inside a text or role gets one backslash after its first character (one more if it has some), which
unescape() takes away again: no text can forge a marker, and every text comes back exactly.  Escaped are the
template's own "<|" and the common "<s>", "</s>", "[INST]" and "[/INST]".

Defined cases: a null text or role is empty; a null turn sorts first, equal turns sort by role, then text; repeated rows
are repeated turns; a null conversation id is one conversation; an empty table gives an empty result; other columns are
ignored.  One string is made of one conversation, so a conversation must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, LOSS, END = "<|start|>", "<|text|>", "<|loss|>", "<|end|>"
#: First character, backslashes, rest of each control string; no rest contains a first character, so matches never overlap.
PLAIN = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and mask: the string's runs as (chars, loss) structs in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = F.array_sort(F.collect_list(one))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(sorted_turns.alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.expr("transform(slice(turns, 1, greatest(size(turns) - 1, 0)), t -> t.role)"))

    def block(turn: Column, previous: Column) -> Column:
        new = ~turn["role"].eqNullSafe(previous)
        loss = turn["role"].isin(*trained)
        opening = F.when(new, F.concat(F.when(previous.isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), escape(turn["role"]))).otherwise(F.lit(""))
        return F.struct(F.concat(opening, F.when(loss, F.lit(LOSS)).otherwise(F.lit(TEXT))).alias("head"), escape(turn["text"]).alias("body"), loss.alias("loss"))

    blocks = grouped.select("conv_id", F.zip_with("turns", before, block).alias("blocks"))
    runs = F.flatten(F.transform("blocks", lambda b: F.array(F.struct(F.char_length(b["head"]).alias("chars"), F.lit(False).alias("loss")), F.struct(F.char_length(b["body"]).alias("chars"), b["loss"].alias("loss")))))
    joined = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"])), "")
    return blocks.select("conv_id", F.concat(joined, F.lit(END)).alias("formatted"), runs.alias("mask"))


def read_conversations(formatted: Column) -> Column:
    """The turns (role, text, loss) in a formatted string, unescaped."""
    mark = lambda s: s.replace("|", r"\|")
    whole = F.split(F.regexp_replace(formatted, r"<\|end\|>\z", ""), mark(END))

    def parts(block: Column) -> Column:
        pieces = F.split(block, r"(?=<\|(?:text|loss)\|>)")
        role = unescape(F.substring(pieces[0], len(START) + 1, 1 << 30))
        return F.transform(
            F.slice(pieces, 2, F.size(pieces)),
            lambda p: F.struct(role.alias("role"), unescape(F.substring(p, len(TEXT) + 1, 1 << 30)).alias("text"), F.startswith(p, F.lit(LOSS)).alias("loss")),
        )

    return F.flatten(F.transform(whole, parts))


def digest(conversations: DataFrame) -> DataFrame:
    """What format_conversations() wrote, read back: counts and SHA-256 digests for each conversation."""
    read = conversations.select("conv_id", "formatted", read_conversations(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
