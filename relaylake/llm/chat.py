"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it, in
order, are context, and only the reply is trainable.

Plan: one shuffle by conversation; a conversation is one row that is sorted and
expanded by array functions, so nothing leaves the JVM. What it takes is the size of
the longest conversation, whose examples are the square of that.

Defined results: turns are ordered by number (null first), then role, then text,
so repeated turn numbers and repeated rows have one order and stay separate
turns; a null text counts as empty and a null role as "unknown"; turns without a
conversation id belong to no conversation, so each stands alone, with empty context;
a conversation without assistant turns gives no example; an assistant turn that comes
first has empty context; very long texts are kept whole; an empty table gives no rows;
input columns besides the four named ones are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_targets(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, position, n_context, prompt, completion, train_start, train_end).

    ``prompt`` ends with the opening of the reply; the trainable span is that of
    ``completion`` in prompt + completion, in characters.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"),
    )
    line = lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit("<|end|>\n"))
    opening, ending = F.lit(f"<|{target_role}|>\n"), F.lit("<|end|>\n")
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.withColumn("said", F.transform("ts", line))
    at = whole.select("conv_id", "ts", "said", F.explode(F.filter(F.transform("ts", lambda t, i: F.when(t.role == target_role, i)), lambda i: i.isNotNull())).alias("i"))
    reply = F.col("ts")[F.col("i")]
    prompt = F.concat(F.array_join(F.slice("said", F.lit(1), F.col("i")), ""), opening)
    made = at.select("conv_id", reply.turn.alias("turn"), (F.col("i") + 1).cast("bigint").alias("position"), F.col("i").cast("bigint").alias("n_context"), prompt.alias("prompt"), F.concat(reply.text, ending).alias("completion"))
    alone = rows.where(F.col("conv_id").isNull() & (F.col("t.role") == target_role))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    made = made.unionAll(alone.select("conv_id", "t.turn", one.alias("position"), none.alias("n_context"), opening.alias("prompt"), F.concat("t.text", ending).alias("completion")))
    start = F.length("prompt").cast("bigint")
    return made.withColumns({"train_start": start, "train_end": start + F.length("completion")})
