"""Chat formatting: preference pairs with one shared prompt and two masked completions.

DataFrame functions only. The longest common prefix of turns is rendered once; what
follows on either side is a completion, with the character spans that a loss may use
(the assistant's turns) beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need, numbered

TURN = "struct<role:string,text:string>"


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as ``conv_id, turns``, in order of turn, role and text.

    Rows with a null conv_id or turn are left out; null roles and texts count as empty.
    Repeated rows are turns of their own, beside each other; further columns are not read.
    """
    rows = need(rows, ["conv_id", "turn", "role", "text"]).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays have in common, role and text alike."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.transform(both, lambda x: F.coalesce(x["a"].eqNullSafe(x["b"]) & x["a"].isNotNull(), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _spans(turns: Column) -> Column:
    """``start:end`` of each assistant's text in the rendered completion, in code points, end exclusive, with its end mark."""
    tail = F.length(F.lit("<|end|>"))
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(_render(x))).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.concat_ws(":", (acc["at"] + F.length(x["role"]) + 5).cast("string"), (acc["at"] + F.length(x["role"]) + 5 + F.length(x["text"]) + tail).cast("string")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return step["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)`` with arrays of turns, as prompt, completions and masks.

    Returns ``pair_id, prefix_turns, prompt, chosen, rejected`` and ``chosen_mask,
    rejected_mask``, the trainable spans of each completion. Null arrays count as empty;
    a pair of equal conversations has two empty completions. Every row gives one row.
    """
    empty = F.array().cast(f"array<{TURN}>")
    turns = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    turns = turns.withColumn("prefix_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c) - F.col("prefix_turns"), F.lit(0)))
    text = lambda c: F.array_join(F.transform(c, _render), "")
    turns = turns.withColumns({"c_rest": rest("c"), "r_rest": rest("r"), "prefix": F.slice("c", 1, F.col("prefix_turns"))})
    return turns.select("pair_id", "prefix_turns", text("prefix").alias("prompt"), text("c_rest").alias("chosen"), text("r_rest").alias("rejected"), _spans(F.col("c_rest")).alias("chosen_mask"), _spans(F.col("r_rest")).alias("rejected_mask"))


def off_topic_pairs(rows: DataFrame) -> DataFrame:
    """Pairs from ``rows(conv_id, turn, role, text)``, one for each conversation with an assistant turn.

    Chosen is the conversation up to its last assistant turn. Rejected is the same with one
    of its assistant turns (that number conv_id modulo their count) in favour of the last
    one of the next conversation: the next conv_id that has any, after the largest the
    smallest. So prefixes end at the first, a middle or the last answer. A conversation
    without another is paired with itself; an empty table gives no pair.
    """
    all_ = conversations(rows)
    roles = F.transform("turns", lambda x: x["role"])
    spoken = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    ended = all_.where(F.array_contains(roles, "assistant")).withColumn("spoken", spoken)
    ended = ended.select("conv_id", F.slice("turns", 1, F.element_at("spoken", -1)).alias("turns"), F.element_at("spoken", (F.pmod("conv_id", F.size("spoken")) + 1).cast("int")).alias("at"))
    ids = numbered(need(rows, ["conv_id", "turn", "role"]).where("conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant'").select("conv_id").distinct(), "conv_id")
    ids = materialize(ids, "places")
    before = ids.select(F.pmod(F.col("place") + 1, F.lit(max(ids.count(), 1))).alias("place"), F.col("conv_id").alias("pair_id"))
    reply = ended.select("conv_id", F.element_at("turns", -1).alias("reply")).join(ids.select("conv_id", "place"), "conv_id").join(before, "place").select(F.col("pair_id").alias("conv_id"), "reply")
    both = ended.join(reply, "conv_id")
    rejected = F.concat(F.slice("turns", 1, F.col("at") - 1), F.array("reply"), F.slice("turns", F.col("at") + 1, F.size("turns")))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
