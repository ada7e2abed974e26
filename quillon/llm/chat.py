"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only
its text is under the loss mask. Turns after the last reply, and conversations without one,
make one more example with an empty mask, so the output holds every turn.

A turn is written ``<|role|>ROLE<|text|>TEXT<|end|>``. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no control string can occur there and nothing is lost.

Only DataFrame functions are used. Rows of a conversation are ordered by turn, then role and
text (ties, repeated rows); null roles and texts count as empty; a null conv_id is one
conversation. Further columns are ignored; an empty table gives no rows. A conversation is one row,
so it must fit into a task, with its prefixes: the output grows with the square of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_examples(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (conv_id, turn, role, text) to examples.

    conv_id, ``example`` (from 0), ``formatted``, ``loss_start`` and ``loss_end``: the places of
    the trainable text in it (code points, end exclusive; equal when there is none).
    """
    empty = F.lit("")
    rows = df.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.struct((t["role"] == "assistant").alias("target"), F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")),
    )
    conv = rows.groupBy("conv_id").agg(turns.alias("turns"))
    size = F.size("turns")
    places = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | F.element_at("turns", i)["target"])
    one = conv.select("conv_id", "turns", F.posexplode(places).alias("example", "upto"))
    shown = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    last = F.element_at("turns", F.col("upto"))
    one = one.select("conv_id", "example", shown.alias("formatted"), last["target"].alias("target"), F.length(last["body"]).alias("size"))
    end = F.length("formatted") - len(END)
    return one.select("conv_id", "example", "formatted", F.when(F.col("target"), end - F.col("size")).otherwise(0).alias("loss_start"), F.when(F.col("target"), end).otherwise(0).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation of ``examples``: ``turns`` (role and text of each), ``loss`` (all text under the mask), ``formatted_chars``."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    shown = F.split("whole", r"<\|end\|>")
    parts = F.transform(F.slice(shown, F.lit(1), F.size(shown) - 1), lambda t: F.split(F.substring(t, F.lit(len(ROLE) + 1), F.length(t)), r"<\|text\|>"))
    return whole.select(
        "conv_id",
        F.transform(parts, lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text"))).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
        "formatted_chars",
    )
