"""Relational chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; runs of adjacent
turns with the same role are merged into one block by slicing the sorted array at the
places where the role changes; blocks are concatenated to

    ### role: text</part>text</turn>

(one line end after ``</turn>``; ``</part>`` marks where two merged turns meet).
Control strings inside roles and texts are escaped reversibly, so ``read_back`` recovers
the original turns from the formatted string alone. ``segments`` cuts the formatted
string into consecutive pieces with a loss flag: exactly the assistant texts are under
the loss mask.

Defined cases: null text or role is the empty string; ties in turn are ordered by role,
then text; repeated rows are repeated turns; null turns sort first; null conv_id is one
conversation of its own; extra columns are ignored; an empty table gives no rows. One
conversation is one string, so its turns must fit one row (2 GB); the rows before that are
aggregated per conversation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
PART_END = "</part>"
HEAD = "### "
ROLE_END = ": "
#: control string and its escaped form (after every backslash is doubled)
CONTROLS = ((TURN_END, "<\\/turn>"), (PART_END, "<\\/part>"), (HEAD, "#\\## "))
ROLE_CONTROLS = (*CONTROLS, (ROLE_END, ":\\ "))


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, controls=CONTROLS) -> Column:
    c = _replace(c, "\\", "\\\\")
    for plain, escaped in controls:
        c = _replace(c, plain, escaped)
    return c


def unescape(c: Column, controls=CONTROLS) -> Column:
    for plain, escaped in reversed(controls):
        c = _replace(c, escaped, plain)
    return _replace(c, "\\\\", "\\")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) per conversation."""
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # places (from 1) where a block of equal roles starts, and one past the end
    starts = sorted_turns.withColumn("starts", F.concat(F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])),
        F.array(F.size("turns") + 1)))
    blocks = starts.withColumn("blocks", F.transform(
        F.sequence(F.lit(1), F.size("starts") - 1),
        lambda b: F.slice("turns", F.element_at("starts", b), F.element_at("starts", b + 1) - F.element_at("starts", b))))

    def block_segments(b: Column) -> Column:
        head = F.struct(F.concat(F.lit(HEAD), escape(b[0]["role"], ROLE_CONTROLS), F.lit(ROLE_END)).alias("text"),
                        F.lit(False).alias("loss"))
        parts = F.flatten(F.transform(b, lambda t, i: F.array(
            F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")),
            F.struct(F.when(i < F.size(b) - 1, F.lit(PART_END)).otherwise(F.lit(TURN_END + "\n")).alias("text"),
                     F.lit(False).alias("loss")))))
        return F.concat(F.array(head), parts)

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", block_segments)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The original turns, array<struct<role, text>>, from a formatted string."""
    blocks = F.split(formatted, TURN_END + "\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # the rest after the last turn end

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(HEAD) + 1, 2147483647), ROLE_END, 1), ROLE_CONTROLS)
        at = F.locate(ROLE_END, block, len(HEAD) + 1) + len(ROLE_END)
        body = block.substr(at, F.lit(2147483647))
        return F.transform(F.split(body, PART_END), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns of the contract, read back from the formatted output."""
    back = formatted.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"),
        unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
