"""Chat formatting with prefix-target expansion, in SQL functions only.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are
escaped: a backslash becomes two and ``<|`` becomes ``<\\|``, so ``<|`` stands for a mark
only and unescaping is exact. Every assistant turn becomes an example: all turns before it are its
context and its own text is trainable. A conversation's text is kept once; an example says
how many of its characters are context and which are trainable, so that long conversations do
not grow with the square of their turns. ``with_context`` writes the contexts out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, END, ROLE_END, TARGET_ROLE = "<|im_start|>", "<|im_end|>\n", "\n", "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: no ``<|`` is left, and in a role no line end either. Null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Inverse of ``escape``; a backslash always begins a pair."""
    # Cut at doubled backslashes, which no other pair can overlap, and mend what is between.
    parts = F.split(text, "\\\\\\\\", -1)
    mend = lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))
    if role:
        mend = lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(parts, mend), "\\")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``examples``.

    ``examples`` has, per assistant turn in order, ``context_chars`` (the context is the text
    up to there, the turn's own head included), ``loss_start`` and ``loss_chars`` of the
    trainable text within ``formatted``, which leaves out the end mark. Turns go by number, nulls
    first; rows with an equal number by role and text, and repeated rows stay. A null role or
    text is empty; a null conversation id is a conversation of its own. A conversation must fit
    in a row, as its digest or text must.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit(ROLE_END)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    placed = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), heads.alias("heads"), bodies.alias("bodies"))
    sized = placed.select(
        "*",
        F.arrays_zip(
            "roles", F.transform("heads", F.char_length).alias("head"), F.transform("bodies", F.char_length).alias("body")
        ).alias("sizes"),
    )
    # One pass carries the place reached so far and adds an example at each assistant turn.
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.expr("cast(array() as array<struct<context_chars:bigint,loss_start:bigint,loss_chars:bigint>>)").alias("found"),
    )

    def step(acc: Column, x: Column) -> Column:
        text_at = acc["at"] + x["head"]
        example = F.struct(
            text_at.alias("context_chars"), text_at.alias("loss_start"), x["body"].cast("bigint").alias("loss_chars")
        )
        return F.struct(
            (text_at + x["body"] + F.lit(len(END))).alias("at"),
            F.when(x["roles"] == TARGET_ROLE, F.concat(acc["found"], F.array(example))).otherwise(acc["found"]).alias("found"),
        )

    return sized.select(
        "conv_id",
        F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))), "").alias("formatted"),
        F.aggregate("sizes", start, step, lambda acc: acc["found"]).alias("examples"),
    )


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id``, ``example`` (from 0), spans and ``reply`` (escaped)."""
    return formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e")).select(
        "conv_id",
        "example",
        "e.*",
        F.substring(F.col("formatted"), F.col("e.loss_start").cast("int") + 1, F.col("e.loss_chars").cast("int")).alias("reply"),
    )


def with_context(formatted: DataFrame) -> DataFrame:
    """Examples with ``context`` and ``reply`` written out, as trainers without spans need them."""
    return formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e")).select(
        "conv_id",
        "example",
        F.substring("formatted", F.lit(1), F.col("e.context_chars").cast("int")).alias("context"),
        F.substring(F.col("formatted"), F.col("e.loss_start").cast("int") + 1, F.col("e.loss_chars").cast("int")).alias("reply"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds, unescaped."""
    marked = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda x: x != "")
    return F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(x, ROLE_END, 1), True).alias("role"),
            unescape(
                F.substring(
                    x,
                    F.char_length(F.substring_index(x, ROLE_END, 1)) + 2,
                    F.char_length(x) - F.char_length(F.substring_index(x, ROLE_END, 1)) - F.lit(1 + len(END)),
                )
            ).alias("text"),
        ),
    )


def read_replies(formatted: Column, examples: Column) -> Column:
    """Array of the trainable texts of a conversation, in order, unescaped."""
    return F.transform(
        examples, lambda e: unescape(F.substring(formatted, e["loss_start"].cast("int") + 1, e["loss_chars"].cast("int")))
    )
