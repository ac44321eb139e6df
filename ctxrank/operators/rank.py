"""Scoring, calibration, ranking, shards, budgets and fusion.

A score depends on the whole scope of a shard; filters are never moved below a scorer. Ties go to the lower chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxrank.functions.fixed import HEADER_RESERVE_TOKENS, MAX_K, RRF_K, SHARD_TOKENS
from ctxrank.operators import lexical

TOKEN = r"[^a-z0-9]+"
#: Queries' terms are held by workers up to this number of rows, as are a task's best; beyond it joins shuffle.
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), TOKEN)), "")


def rounded(x: Column, digits: int) -> Column:
    """As SQL's round() of doubles (lexical.rounded)."""
    y = F.abs(x * F.lit(10.0**digits))
    whole = F.floor(y).cast("double")
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def lexical_model(queries: DataFrame, chunks: DataFrame, null_text: str = "N/A") -> lexical.Model | None:
    """None where the queries have too many terms for the workers."""
    if queries.select(F.explode(terms(F.col("text")))).limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    asked = queries.select(F.col("query_id").cast("bigint"), "text").where(F.size(terms(F.col("text"))) > 0)
    return lexical.Model([tuple(r) for r in asked.collect()], chunks, null_text)


def lexical_scores(queries: DataFrame, chunks: DataFrame, null_text: str = "N/A", k: int | None = None, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, raw, null_score, score) of chunks that share a term with a query.

    A stand-in for a model: the sum of ln(1 + n / df) over shared distinct terms; score = raw - null, rounded, the null
    being the score of a query without content. With k, pairs that are not among their query's k best may be missing.
    """
    model = lexical_model(queries, chunks, null_text)
    if model is None:
        return joined_scores(queries, chunks, null_text).withColumn("score", F.round(F.col("raw") - F.col("null_score"), digits))
    if k is not None and len(model.ids) * k > 10 * BROADCAST_TERMS:
        k = None
    return lexical.scores(model, chunks, k, digits)


def joined_scores(queries: DataFrame, chunks: DataFrame, null_text: str) -> DataFrame:
    """lexical_scores() by joins."""
    wanted = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    null = queries.sparkSession.range(1).select(F.explode(terms(F.lit(null_text))).alias("term"))
    vocabulary = wanted.select("term").union(null).distinct()
    few = vocabulary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    n = chunks.count()
    held = chunks.select("chunk_id", F.explode(terms(F.col("text"))).alias("term")).join(hint(vocabulary), "term")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.log(1 + F.lit(float(n)) / F.col("df")).alias("w"))
    weighted = wanted.join(hint(weights), "term")
    raw = held.join(hint(weighted), "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("raw"))
    nulls = held.join(hint(null), "term").join(hint(weights), "term").groupBy("chunk_id").agg(F.sum("w").alias("null_score"))
    both = raw.join(nulls, "chunk_id", "left").withColumn("null_score", F.coalesce("null_score", F.lit(0.0)))
    return both.select("query_id", "chunk_id", F.round("raw", 9).alias("raw"), F.round("null_score", 9).alias("null_score"), F.round(F.col("raw") - F.col("null_score"), 9).alias("score"))


def best_places(queries: DataFrame, chunks: DataFrame, null_text: str = "N/A", digits: int = 9) -> DataFrame:
    """(query_id, best): the place from 1, in its query's whole ranking, of the best chunk that holds the query's text; queries without one have no row."""
    model = lexical_model(queries, chunks, null_text)
    if model is not None:
        return queries.sparkSession.createDataFrame(lexical.best_places(model, chunks, digits), "query_id bigint, best bigint")
    scores = joined_scores(queries, chunks, null_text).withColumn("score", F.round(F.col("raw") - F.col("null_score"), digits))
    places = scores.withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("bigint"))
    held = queries.select("query_id", F.col("text").alias("asked")).join(chunks.select("chunk_id", "text"), F.contains("text", "asked")).select("query_id", "chunk_id")
    return held.join(places, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("best").alias("best"))


def top_k(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """(…, rank) 0-based; k is at most MAX_K."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(k, MAX_K))  # so that Spark limits each task's rows first
    return best.withColumn("rank", F.col("rank").cast("bigint") - 1)


def interleave(scores: DataFrame) -> DataFrame:
    """(shard_id, chunk_id, score) with rank: first of each shard in the order of shards, then the second ones, …"""
    own = Window.partitionBy("query_id", "shard_id").orderBy(F.desc("score"), "chunk_id")
    merged = Window.partitionBy("query_id").orderBy("own", "shard_id")
    return scores.withColumn("own", F.row_number().over(own)).withColumn("rank", F.row_number().over(merged).cast("bigint") - 1).drop("own")


def shard_plan(lengths: list[int], overhead: int = 0, most: int = SHARD_TOKENS) -> list[int]:
    """Shard of each chunk in order: contiguous, about equal, each within `most` with the overhead."""
    if any(n + overhead > most for n in lengths):
        raise ValueError("a chunk is longer than a shard may be")
    body, k = sum(lengths), 1
    if body + overhead > most:
        k = -(-body // (most - overhead))
    while True:
        target, out, shard, used = body / k, [], 0, 0
        for n in lengths:
            if used and used + n > target and shard < k - 1:
                shard, used = shard + 1, 0
            out.append(shard)
            used += n
        held: dict[int, int] = {}
        for s, n in zip(out, lengths):
            held[s] = held.get(s, 0) + n
        if max(held.values(), default=0) + overhead <= most:
            return out
        k += 1


def fill(items: Column, cap: int, start: int = 0) -> Column:
    """Ids taken from array<struct<rank, id, cost>> in order: the first always, then each that still fits; others are passed over."""
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(start).cast("bigint").alias("used"), none.alias("kept"))

    def step(acc, x):
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["cost"] <= cap)
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["id"]))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(items, zero, step)


def admitted(ranking: DataFrame, group: str, cap: int, start: int = 0) -> DataFrame:
    """(group, id, place, used): what a budget admits of rankings (group, rank, id, cost) of at most MAX_K rows each."""
    held = ranking.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("items"))
    got = held.select(group, fill(F.col("items"), cap, start).alias("f"))
    return got.select(group, F.posexplode("f.kept").alias("place", "id"), F.col("f.used").alias("used")).withColumn("place", F.col("place").cast("bigint"))


def packed(ranking: DataFrame, group: str, budget: int) -> DataFrame:
    return admitted(ranking, group, budget, HEADER_RESERVE_TOKENS)


def two_tiers(theta: DataFrame, second: DataFrame) -> DataFrame:
    """theta (query_id, chunk_id, rank, score) reordered: those with a second score first, by it, then the tail as it was."""
    both = theta.join(second.select("query_id", "chunk_id", F.col("score").alias("s2"), F.lit(True).alias("reranked")), ["query_id", "chunk_id"], "left")
    return reordered(both.withColumn("reranked", F.coalesce("reranked", F.lit(False))))


def reordered(both: DataFrame) -> DataFrame:
    """two_tiers() of rows that have their second score (s2) and whether there is one (reranked)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("reranked"), F.desc_nulls_last("s2"), "rank")
    return both.select("query_id", "chunk_id", "reranked", F.coalesce("s2", "score", F.lit(0.0)).alias("score"), (F.row_number().over(w).cast("bigint") - 1).alias("rank"))


def fuse(rankings: DataFrame, k: int = 6) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank[, reranked]): (chunk_id, rrf, votes, best_rank, place)."""
    held = rankings.groupBy("chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank") + 1)), 9).alias("rrf"), F.count("*").alias("votes"), F.min(F.col("rank") + 1).alias("best_rank"), F.min(F.struct("query_id", "rank")).alias("seen"))
    top = held.orderBy(F.desc("rrf"), "best_rank", "seen.query_id", "seen.rank").limit(k)
    w = Window.orderBy(F.desc("rrf"), "best_rank", "seen.query_id", "seen.rank")  # k rows
    return top.select("chunk_id", "rrf", "votes", "best_rank", (F.row_number().over(w).cast("bigint") - 1).alias("place"))


def gist(text: Column, n: int = 32) -> Column:
    """The first n words, or the first and last n / 2 of a longer text."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    half = n // 2
    both = F.concat(F.array_join(F.slice(words, 1, half), " "), F.lit(" ... "), F.array_join(F.slice(words, -half, half), " "))
    return F.when(F.size(words) <= n, F.array_join(words, " ")).otherwise(both)
