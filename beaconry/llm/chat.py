"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """Texts free of control strings: none starts without `<|`."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&n;"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&n;"), F.lit("\n")))


def format_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its key, `formatted`, and `segments` (text, loss).

    Turns are collected as structs, sorted by turn, role and text, and adjacent turns of one role
    become one block: its texts, kept apart by a mark, between a start with the role and an end. The
    segments joined give `formatted`; those with `loss` are the assistant's texts, escaped. Null texts
    and roles are empty, null turns come last, a null key is a conversation of its own, repeated
    rows are turns, other columns are ignored, and no turns give no rows. A conversation is one row of
    the result, so its turns meet in one task; what they need is combined before the shuffle.
    """
    item = F.struct(
        F.col(turn).isNull().alias("unnumbered"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    # Blocks begin where the role changes; each takes the slice of turns up to the next beginning.
    begins = F.filter(
        F.sequence(F.lit(1), F.size("_turns")),
        lambda i: (i == 1) | (F.get("_turns", i - 1)["role"] != F.get("_turns", F.greatest(i - 2, F.lit(0)))["role"]),
    )
    blocks = F.transform(
        "_begins",
        lambda b, k: F.struct(
            F.get("_turns", b - 1)["role"].alias("role"),
            F.slice("_turns", b, F.coalesce(F.get("_begins", k + 1), F.size("_turns") + 1) - b).alias("turns"),
        ),
    )

    def segments(block):
        head = F.concat(F.lit(START), _escape_role(block["role"]), F.lit("\n"))
        bodies = F.transform(
            block["turns"],
            lambda t, i: F.array(
                F.struct(F.when(i == 0, head).otherwise(F.lit(TURN)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), (block["role"] == "assistant").alias("loss")),
            ),
        )
        return F.concat(F.flatten(bodies), F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))))

    return (
        sorted_turns.withColumn("_begins", begins)
        .withColumn("_blocks", blocks)
        .select(key, F.flatten(F.transform("_blocks", segments)).alias("segments"))
        .select(key, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(
                F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(END) - 1), r"<\|turn\|>"
            ),
            lambda t: F.struct(
                _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
                unescape(t).alias("text"),
            ),
        ),
    )
    return F.flatten(turns)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
