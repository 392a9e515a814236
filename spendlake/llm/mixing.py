"""Mixing sources to target weights by pivotal dependent rounding.

Sources in order of code point, NULL last, weigh 1, 2, 3, repeating, and share
all words. A target stops at ``MOST_COPIES`` times its source's words; the excess is
shared again. Each document of a source starts with the same fractional copies,
target / source words. Rounding pairs the open document with the next smaller
one and moves words between them, up or down at random so that each keeps its
expected copies, until one is whole: a source's words stay the same through
every step. Blocks of documents are rounded in parallel; what stays open in each
(one document of a source) is combined by a tree of blocks.

Chances follow from a seed and the ``doc_id``, blocks from the row count: reruns
agree. NULL and empty texts have no words and are taken no times. Repeated rows
are mixed each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import block_count, free_name, mixed, staged

MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 20_000
#: Blocks whose open documents one task of the tree combines.
FAN_IN = 64

_STATE = "doc_id long, turn int, source_id long, size long, copies double, block long, open boolean"


def word_count(text):
    """Words of a text column; NULL has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_id, source_size, target`` from rows with ``source`` and ``size``.

    The level at which targets stand is found in rounds: each caps the sources
    that the level of the last one overfills, until none is above.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[1], x[0]["source_size"]))
    sources = spark.createDataFrame(numbered, "source string, source_id long, source_size long")
    sources = staged(sources.withColumn("weight", F.col("source_id") % 3 + 1), "mix-sources")
    cap, weight = F.col("source_size") * MOST_COPIES, F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = weight * level >= cap
        now = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.sum(F.when(over, cap)).alias("words"),
            F.sum(F.when(~over, weight)).alias("weight"),
        ).first()
        if now["n"] == capped or not now["weight"]:
            break
        capped, level = now["n"], (total - (now["words"] or 0)) / now["weight"]
    return sources.select(
        "source", "source_id", "source_size", F.least(cap.cast("double"), weight * level).alias("target")
    )


def _round(size: np.ndarray, copies: np.ndarray, chance: np.ndarray, last: bool) -> np.ndarray:
    """Rounds ``copies`` in place, in the given order; True where a row stays open."""
    still = np.zeros(len(size), bool)
    near = np.rint(copies)
    whole = np.abs(copies - near) < 1e-9
    copies[whole] = near[whole]
    i = -1
    for j in np.flatnonzero(~whole).tolist():
        if i < 0:
            i = j
            continue
        part = copies[i] - np.floor(copies[i])
        up = min((1 - part) * size[i], copies[j] * size[j])
        down = min(part * size[i], (MOST_COPIES - copies[j]) * size[j])
        move = up if chance[j] * (up + down) < down else -down
        copies[i] += move / size[i]
        copies[j] -= move / size[j]
        for k in (i, j):
            if abs(copies[k] - np.rint(copies[k])) < 1e-9:
                copies[k] = np.rint(copies[k])
        unsettled = [k for k in (i, j) if copies[k] != np.rint(copies[k])]
        i = unsettled[-1] if unsettled else -1
        if len(unsettled) == 2:  # rounding error only: settle the larger
            copies[unsettled[0]] = np.rint(copies[unsettled[0]])
    if i >= 0:
        if last:
            base = np.floor(copies[i])
            copies[i] = base + (chance[i] < copies[i] - base)
        else:
            still[i] = True
    return still


def _rounded(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: the open rows of each block and source are rounded together."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "turn"], ascending=[False, True, True], kind="stable")
        key = frame["doc_id"].fillna(0).astype("int64").to_numpy().view(np.uint64)
        turn = frame["turn"].to_numpy().astype(np.uint64)
        salt = np.uint64((seed * 0x9E3779B97F4A7C15 + (1 if last else 0)) % 2**64)
        chance = (mixed(mixed(key ^ salt) + turn) >> np.uint64(11)) / 2.0**53
        copies = frame["copies"].to_numpy(copy=True)
        frame["open"] = _round(frame["size"].to_numpy().astype(float), copies, chance, last)
        frame["copies"] = copies
        return frame

    return rows.groupBy("source_id", "block").applyInPandas(settle, _STATE)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, source, turn, size, source_size, target, copies`` of every row of ``docs``.

    ``turn`` numbers rows that share doc_id, source and size.
    """
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))
    sized = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")
    )
    sized = staged(sized.withColumn("turn", F.row_number().over(same)), "mix-sizes")
    shares = staged(targets(sized), "mix-targets")
    blocks = block_count(sized.count(), BLOCK_ROWS)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(shares, sized["source"].eqNullSafe(shares["source"])).select(
        "doc_id",
        "turn",
        "source_id",
        "size",
        F.when(F.col("size") > 0, share).otherwise(0.0).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "turn"), F.lit(blocks)).alias("block"),
        F.lit(True).alias("open"),
    )
    settled = None
    while True:
        level = staged(_rounded(rows, seed, blocks == 1), "mix-level")
        done = level.filter("NOT open")
        settled = done if settled is None else settled.union(done)
        if blocks == 1:
            break
        blocks = block_count(blocks, FAN_IN)
        rows = level.filter("open").withColumn("block", F.pmod("block", F.lit(blocks)))
    return settled.join(shares, "source_id").select(
        "doc_id", "source", "turn", "size", "source_size", "target", F.col("copies").cast("int").alias("copies")
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    size, turn = free_name(docs, "mix_size"), free_name(docs, "mix_turn")
    same = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    rows = docs.withColumn(size, word_count(F.col("text"))).withColumn(turn, F.row_number().over(same))
    plan = mix(docs, seed).filter("copies > 0").select(
        F.col("doc_id").cast("long").alias("_doc_id"), F.col("source").alias("_source"),
        F.col("size").alias("_size"), F.col("turn").alias("_turn"), F.col("copies").alias("_copies"),
    )
    taken = rows.join(
        plan,
        rows["doc_id"].cast("long").eqNullSafe(plan["_doc_id"])
        & rows["source"].cast("string").eqNullSafe(plan["_source"])
        & (rows[size] == plan["_size"])
        & (rows[turn] == plan["_turn"]),
    )
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
