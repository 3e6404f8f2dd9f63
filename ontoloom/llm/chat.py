"""Chat formatting by relational expressions only: no Python runs on the executors.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block by array
aggregation; blocks are concatenated. Block::

    <turn:ROLE>TEXT<next>TEXT</turn>\n

Roles and texts are escaped (``&`` to ``&amp;``, ``<`` to ``&lt;``, ``>`` to ``&gt;``), so no control string can occur inside
one, and undoing the three replacements in reverse order gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<turn:", "<next>", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def _merge(blocks: Column, turn: Column) -> Column:
    """Append the turn to the last block if that has its role, else open a block."""
    last = F.element_at(blocks, -1)
    one = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    longer = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))))
    return F.when((F.size(blocks) > 0) & (last["role"] == turn["role"]), longer).otherwise(F.concat(blocks, F.array(one)))


def formatted(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; other columns are not read) to conv_id, formatted: one row a conversation.

    Turns are in order of turn (null first), ties in order of role and text; rows that repeat are turns of their own.
    A null text or role is empty. Rows with a null conv_id make one conversation of their own. No rows: no rows.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_ = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    start = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")
    blocks = F.aggregate("turns", start, _merge)
    one = lambda b: F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(">"), F.array_join(F.transform(b["texts"], escaped), NEXT), F.lit(CLOSE))
    return sorted_.select("conv_id", F.array_join(F.transform(blocks, one), "").alias("formatted"))


def parsed(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What formatted() wrote, read back from its text: conv_id, formatted, turns (role, text) in order, and loss_texts, the
    texts under the loss mask."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    head = lambda b: F.substring_index(b, ">", 1)
    role = lambda b: unescaped(F.substring(head(b), F.lit(len(OPEN) + 1), F.length(head(b))))
    texts = lambda b: F.split(F.substring(b, F.length(head(b)) + 2, F.length(b)), NEXT, -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda x: F.struct(role(b).alias("role"), unescaped(x).alias("text")))))
    read = chats.select("conv_id", "formatted", turns.alias("turns"))
    return read.withColumn("loss_texts", F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]))
