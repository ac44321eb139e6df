"""Entry points: a scope of files, queries and a budget in; ranked, packed and located chunks out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxrank.functions import globs
from ctxrank.functions.fixed import BUDGET_DEFAULT, BUDGET_MAX, BUDGET_MIN, CHUNK_CHARS
from ctxrank.operators import chunks as ch
from ctxrank.operators import rank, scan
from ctxrank.sources import files as source


@dataclass
class Scope:
    """A declared scope: accepted files, cut into chunks with ids in path order."""

    files: DataFrame
    chunks: DataFrame
    coverage: DataFrame


def scope(spark: SparkSession, root: str, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, split: str = "window", chunk_chars: int = CHUNK_CHARS) -> Scope:
    wanted, unwanted = globs.norm_globs(include), globs.all_excludes(exclude)
    listed = source.catalogue(spark, root, wanted)
    accepted = scan.scan(listed, wanted, unwanted).where("reason = 'accepted'")
    texts = source.read_texts(accepted, root)
    cut = ch.head_chunks(texts, chunk_chars).withColumn("part", F.lit(0).cast("bigint")) if split == "head" else ch.with_header(ch.window_chunks(texts, chunk_chars))
    cut = cut.withColumn("chunk_id", F.row_number().over(Window.orderBy("path", "part")).cast("bigint") - 1)  # a scope is at most MAX_CHUNKS chunks
    return Scope(texts, cut, scan.coverage(listed, wanted, unwanted))


def check_budget(budget: int) -> None:
    if isinstance(budget, bool) or not isinstance(budget, int) or not BUDGET_MIN <= budget <= BUDGET_MAX:
        raise ValueError(f"budget must be a whole number from {BUDGET_MIN} to {BUDGET_MAX}")


def retrieve(spark: SparkSession, chunks: DataFrame, query: str, budget: int = BUDGET_DEFAULT, k: int = 32, scorer: Callable = rank.lexical_scores) -> DataFrame:
    """(place, chunk_id, path, start_line, score) of the best chunks that the budget admits."""
    check_budget(budget)
    queries = spark.createDataFrame([(0, query)], "query_id bigint, text string")
    return multi_retrieve_ranked(rank.top_k(scorer(queries, chunks), k), chunks, budget)


def multi_retrieve_ranked(ranking: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    costs = ranking.join(chunks.select("chunk_id", "path", "start_line", scan.tokens(F.length("text")).alias("cost")), "chunk_id")
    kept = rank.packed(costs.withColumn("id", F.col("chunk_id")), "query_id", budget)
    return kept.join(costs.select("query_id", F.col("chunk_id").alias("id"), "path", "start_line", "score"), ["query_id", "id"]).select("place", F.col("id").alias("chunk_id"), "path", "start_line", "score").orderBy("place")


def multi_retrieve(spark: SparkSession, chunks: DataFrame, queries: Iterable[str], k: int = 6, per_query_k: int = 10, scorer: Callable = rank.lexical_scores) -> DataFrame:
    """Fused ranking of up to eight queries, scored together."""
    texts = [q.strip() for q in queries if q and q.strip()]
    if not 1 <= len(texts) <= 8:
        raise ValueError("from 1 to 8 queries")
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    return rank.fuse(rank.top_k(scorer(asked, chunks), per_query_k), k)
