"""Content identity of scopes, reuse of what has not changed, and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scope_keys(chunks: DataFrame, group: str, scorer: str = "lexical") -> DataFrame:
    """(group, n_chunks, scope_key): hash of the scorer, the number of chunks and the hashes of all texts in order.

    Only hashes of texts are brought together, 64 characters a chunk.
    """
    held = chunks.select(group, "chunk_id", F.sha2("text", 256).alias("h")).groupBy(group).agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "h"))), lambda x: x["h"]), ",").alias("all"))
    return held.select(group, "n_chunks", F.substring(F.sha2(F.concat(F.lit(f"{scorer}|"), F.col("n_chunks").cast("string"), F.lit("|"), "all"), 256), 1, 32).alias("scope_key"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))


def block_bounds(lengths: Column, block: int) -> Column:
    """Starts of blocks of at least `block` tokens each, at chunk starts; stretches of over two blocks are cut every `block` tokens."""
    long = lambda x: F.lit(x).cast("bigint")
    total = F.aggregate(lengths, long(0), lambda a, n: a + n)
    zero = F.struct(long(0).alias("at"), F.array(long(0)).alias("bounds"))

    def step(acc, n):
        start, last = acc["at"] + n, F.element_at(acc["bounds"], -1)
        cuts = F.greatest(F.lit(0), F.ceil((start - last - 2 * block) / block).cast("int"))
        inner = F.when(cuts > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), cuts)), lambda i: last + i * block)).otherwise(F.array().cast("array<bigint>"))
        fresh = (start - (last + cuts * block) >= block) & (start < total)
        return F.struct(start.alias("at"), F.concat(acc["bounds"], inner, F.when(fresh, F.array(start)).otherwise(F.array().cast("array<bigint>"))).alias("bounds"))

    return F.aggregate(lengths, zero, step, lambda a: a["bounds"])


def reusable(bounds: Column, prefix: Column) -> Column:
    """The last block start at or before the common prefix."""
    return F.array_max(F.filter(bounds, lambda b: b <= prefix))


def evicted(scopes: DataFrame, group: str, capacity: int) -> DataFrame:
    """scopes (group, key, n_tokens, last_used) with held: kept from the newest on while they fit together."""
    w = Window.partitionBy(group).orderBy(F.desc("last_used"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    return scopes.withColumn("running", F.sum("n_tokens").over(w)).withColumn("held", F.col("running") <= capacity)
