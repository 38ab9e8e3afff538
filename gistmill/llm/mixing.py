"""Mixing sources to target weights by entropy balancing.

Documents get rates that are exponentially tilted from a common start, the mean share, and
meet one token constraint per source: the sum of rate times size is the source's target.
The convex dual has one multiplier a source, on size; Newton steps solve it, each a Spark
aggregation of (source, size) cells. So within a source the rate goes with the size. A rate
stays below 2 because the entropy is the bounded one: its odds, rate / (2 - rate), are what
is tilted. Rates are then rounded into copies 0, 1 or 2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import WORD, materialize, need, numbered, sized_join, unwrap, wrapped

#: Weights that sources get in the order of their names, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: The top bits of the hash that salt a cell: 64 groups.
SALT_BITS = 6


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size.

    The excess over a cap goes to the others by weight until none is above. Two numbers a
    round reach the driver, not the sources.
    """
    ranked = numbered(sources, F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * most), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        free = F.col("w") * level < F.col("cap")
        used, weight, n = ranked.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("w"))), F.count_if(~free)).first()
        if not weight or n == full:
            break
        level, full = (total * share - (used or 0)) / weight, n
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _solve(cells: DataFrame, goals: DataFrame, share: float, most: float, rounds: int = 100) -> DataFrame:
    """Multipliers ``(source, tilt)``: Newton on the dual, one aggregation a round, until all totals meet their targets.

    Steps are on the logit of the total as a share of its cap, which is nearly linear in the
    multiplier; a step that leaves the bracket found so far halves it instead. Raises if a
    target is not met after ``rounds``.
    """
    scale = F.col("size") / F.col("mean_size")
    state = goals.where("source_size > 0 AND target > 0").withColumn("mean_size", F.col("source_size") / F.col("n"))
    # A source at its cap takes everything; no multiplier is finite there.
    state = state.withColumn("at_cap", F.col("target") >= F.col("source_size") * most * (1 - 1e-9))
    base = float(np.log(share / (most - share))) if 0 < share < most else 0.0
    state = state.withColumn("base", F.lit(base)).withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    state = materialize(state, "tilts")
    cap = F.col("source_size") * most
    worst = None
    for _ in range(rounds):
        met = sized_join(cells, state, cells["source"].eqNullSafe(state["source"]), "inner").where("NOT at_cap").drop(cells["source"])
        rate = most / (1 + F.exp(-(F.col("base") + F.col("tilt") * scale)))
        sums = met.groupBy("source").agg(
            F.sum(F.col("n_docs") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n_docs") * F.col("size") * scale * rate * (1 - rate / most)).alias("slope"),
        )
        sums = sums.withColumnRenamed("source", "__s")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        gap = F.when(F.col("at_cap"), 0.0).otherwise(F.abs(F.col("got") / F.col("target") - 1))
        state = state.withColumn("gap", gap).withColumn("low", F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low")))
        state = state.withColumn("high", F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        inside = (F.col("got") > 0) & (F.col("got") < cap) & (F.col("slope") > 0)
        step = (F.log(F.col("target") / (cap - F.col("target"))) - F.log(F.col("got") / (cap - F.col("got")))) * F.col("got") / F.col("slope") * (1 - F.col("got") / cap)
        far = 4 + 2 * F.abs("tilt")
        up = F.when(F.col("got") < F.col("target"), far).otherwise(-far)
        new = F.col("tilt") + F.when(inside, F.greatest(-far, F.least(far, step))).otherwise(up)
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        new = F.when(bounded & ~((new > F.col("low")) & (new < F.col("high"))), (F.col("low") + F.col("high")) / 2).otherwise(new)
        state = state.withColumn("tilt", F.when(F.col("gap") < 1e-9, F.col("tilt")).otherwise(new))
        state = materialize(state, "tilts")
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("got", "slope", "gap")
        if (worst or 0) < 1e-9:
            return state.select("source", "target", "base", "tilt", "mean_size", "at_cap")
    raise RuntimeError(f"mixing: a source's total is off its target by a share of {worst} after {rounds} rounds")


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the cells of one source: largest sizes first, each taking what brings the words taken nearest to what its rates and those before ask for."""
    pdf = pdf.sort_values("size", ascending=False)
    wanted = taken = 0.0
    extra = []
    for size, n, rate in zip(pdf["size"], pdf["n_docs"], pdf["rate"], strict=True):
        whole = np.floor(rate)
        wanted += n * size * (rate - whole)
        k = int(min(max(np.floor((wanted - taken) / size + 0.5), 0), n)) if size and rate > whole else 0
        taken += k * size
        extra.append(k)
    return pdf.assign(extra=np.array(extra, np.int64))[["source", "size", "n_docs", "rate", "extra"]]


def copies_of(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, source, size)`` with ``copies``, and the sources' table.

    Copies depend on source, size and a hash of doc_id alone: rows that repeat these get
    the same copies, and reruns agree. Documents without words are never taken. Cells
    are pre-aggregated before any shuffle; there are at most as many to a source as
    there are different sizes. Within a cell the documents with the smallest hashes
    get the extra copy; their ranks come from salted groups, so one large cell is spread.
    """
    rows = need(docs, ["doc_id", "source", "size"]).withColumn("u", F.xxhash64(F.lit("mix"), "doc_id", "source", "size"))
    cells = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n_docs")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size"), F.sum("n_docs").alias("n"))
    goals = targets(sources.select("source", "source_size"), weights, share, most)
    named = goals.withColumnRenamed("source", "__s")
    goals = materialize(sources.join(named.drop("source_size"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "goals")
    tilts = _solve(cells, goals, share, most).withColumnRenamed("source", "__s")
    rated = cells.join(tilts, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("at_cap"), most).otherwise(most / (1 + F.exp(-(F.col("base") + F.col("tilt") * F.col("size") / F.col("mean_size")))))
    rated = rated.select("source", "size", "n_docs", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))
    plan = materialize(rated.groupBy("source").applyInPandas(_round, "source string, size long, n_docs long, rate double, extra long"), "plan")
    # The hash up to which a cell's documents get the extra copy.
    some = plan.where("extra > 0").select(F.col("source").alias("__s"), F.col("size").alias("__z"), "extra")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
    salted = sized_join(rows, some, same, "inner").select("source", "size", "extra", "u", F.shiftright("u", 64 - SALT_BITS).alias("part"))  # in the order of u
    parts = salted.groupBy("source", "size", "extra", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    last = before.where("before < extra AND before + n >= extra").select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("part").alias("__p"), (F.col("extra") - F.col("before")).alias("nth"))
    inside = salted.join(last, same & (F.col("part") == F.col("__p"))).drop("__s", "__z", "__p")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("u")))
    limits = ranked.where("rank = nth").select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("u").alias("upto"))
    limits = plan.join(limits, same, "left").select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.floor("rate").alias("whole"), "upto")
    limits = materialize(limits, "limits")
    out = sized_join(rows, limits, same, "left").drop("__s", "__z")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("u") <= F.col("upto"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", copies.cast("int").alias("copies")), goals


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs(doc_id, text, source)``.

    Null texts have size 0, and so have texts of white space; they are never taken. Null
    sources form one source, the last. An empty table gives an empty result.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows, goals = copies_of(sizes, weights, share, most)
    goals = goals.select(F.col("source").alias("__s"), "source_size", "target")
    rows = sized_join(rows, goals, F.col("source").eqNullSafe(F.col("__s")), "inner")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs``, all columns, with each row as often as the mix takes it (0, 1 or 2 times).

    Null texts and texts without words are never taken; null sources form one source, the
    last; null doc_ids and repeated rows take part like others, rows that repeat doc_id,
    source and size each getting the same copies. Columns may have any names; an empty
    table gives an empty result.
    """
    sized = docs.select(wrapped(docs).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows, _ = copies_of(materialize(sized.select("doc_id", "source", "size"), "sizes"), weights, share, most)
    taken = rows.where("copies > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
    met = sized_join(sized, materialize(taken, "taken"), same, "inner")
    return unwrap(met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), "row", docs.columns)
