"""Reading chunk scores out of attention weights: positions meet spans by equality, after spans are spread over their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(spans: DataFrame, position: str) -> DataFrame:
    """(chunk_id, position) for spans (chunk_id, start, end), end exclusive."""
    return spans.where("end > start").select("chunk_id", F.explode(F.sequence("start", F.col("end") - 1)).alias(position))


def pooled(weights: DataFrame, spans: DataFrame) -> DataFrame:
    """(layer, chunk_id, score): mean over heads and query rows of each position, then over the chunk's positions.

    weights: (layer, head, q_pos, k_pos, w). Spans that end beyond the positions there are do not count.
    """
    length = weights.agg(F.max("k_pos").alias("last"))
    usable = spans.join(F.broadcast(length), F.col("end") <= F.col("last") + 1).drop("last")  # one row
    column = weights.groupBy("layer", "k_pos").agg(F.avg("w").alias("w"))
    return column.join(spread(usable, "k_pos"), "k_pos").groupBy("layer", "chunk_id").agg(F.round(F.avg("w"), 9).alias("score"))


def blocked_mean(parts: DataFrame) -> DataFrame:
    """(chunk_id, score) from means of blocks (chunk_id, block, score, n): weighted by the blocks' rows."""
    return parts.groupBy("chunk_id").agg(F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 9).alias("score"))


def calibrated(real: DataFrame, null: DataFrame) -> DataFrame:
    """(chunk_id, score): real less null; a missing null counts as 0."""
    both = real.join(null.withColumnRenamed("score", "null_score"), "chunk_id", "left")
    return both.select("chunk_id", F.round(F.col("score") - F.coalesce("null_score", F.lit(0.0)), 9).alias("score"))


def affinity(weights: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(row_chunk, col_chunk, score): mean weight between the positions of two chunks, averaged over layers."""
    r = spread(rows, "q_pos").withColumnRenamed("chunk_id", "row_chunk")
    c = spread(columns, "k_pos").withColumnRenamed("chunk_id", "col_chunk")
    by_layer = weights.join(r, "q_pos").join(c, "k_pos").groupBy("layer", "row_chunk", "col_chunk").agg(F.avg("w").alias("w"))
    return by_layer.groupBy("row_chunk", "col_chunk").agg(F.round(F.avg("w"), 9).alias("score"))
