"""Benchmark decontamination by spaced-seed hashing (operator 6; DataFrame functions only).

Words are lower-cased runs of letters and digits. A mask fixes which of a window's words count (1) and which
are ignored (0). All windows of the benchmark's items are hashed under every mask of MASKS and joined with
those of the documents. Each hit gives a diagonal (document position less item position), on which the item
is laid over the document word by word; the item is found when at least `least` of its words agree.
Items of fewer than SHORT words are also hashed under SHORT_MASKS, which leave no pattern of changed words that a fourth
allows uncovered up to 12 words; those of one to three words are hashed whole.

The benchmark's windows are broadcast while there are at most BROADCAST_ROWS of them, and its items while they have
BROADCAST_WORDS words at most (both counted first, 10 and 16 MB); beyond, the joins shuffle, windows without the words they come from. clean() broadcasts the ids that it drops up to BROADCAST_ROWS.

Defined results: null and empty texts and items hit nothing; an item without words is in no document; repeated
documents are reported once for each doc_id and item, with the best overlap (ties: the first place); an empty table on either side
gives no rows; other columns are ignored by find() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed_text, materialize

MASKS = ("11111", "1101011", "1100101011")
SHORT, SHORT_MASKS = 20, ("111", "11011", "1011", "1101")
LEAST = 0.75
BROADCAST_ROWS, BROADCAST_WORDS = 400_000, 2_000_000


def words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seed(mask: str, at: Column) -> Column:
    """Hash of the words that the mask keeps, from position `at` (0-based) of w; null beyond the end."""
    kept = [F.get(F.col("w"), at + F.lit(i)) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + F.lit(len(mask)) <= F.col("n"), F.xxhash64(F.lit(mask), *kept))


def windows(rows: DataFrame, masks: list[str]) -> DataFrame:
    """rows (..., w, n) for each place `at` and each mask that fits there, with its seed."""
    at = F.col("at")
    placed = rows.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return placed.select("*", F.explode(F.array(*[seed(m, at) for m in masks])).alias("seed")).where("seed is not null")


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, matched, item_words, overlap, start_word) of each document and item that it holds."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    items = materialize(items.where(F.size("w") > 0).dropDuplicates().withColumn("n", F.size("w")), "items")
    size = items.agg(F.sum("n").alias("words"), F.min("n").alias("least"), F.collect_set(F.when(F.col("n") < 4, F.col("n"))).alias("tiny")).first()
    masks = list(MASKS)
    known = windows(items, masks)
    if size.least is not None and size.least < SHORT:
        whole = ["1" * n for n in sorted(size.tiny) if n != 3]  # three words are a mask already
        masks += [*SHORT_MASKS, *whole]
        short = windows(items.where((F.col("n") < SHORT) & (F.col("n") > 2)), list(SHORT_MASKS))
        known = known.union(short)
        for mask in whole:
            known = known.union(windows(items.where(F.col("n") == len(mask)), [mask]))
    known = materialize(known.select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    few = known.count() <= BROADCAST_ROWS
    texts = keyed_text(docs).select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    start = (F.col("at") - F.col("item_at")).alias("start")
    if few:
        hits = windows(texts, masks).join(F.broadcast(known), "seed").select("doc_id", "w", "item_id", start)
    else:
        hits = windows(texts, masks).select("doc_id", "at", "seed").join(known, "seed").select("doc_id", "item_id", start).distinct().join(texts.select("doc_id", "w"), "doc_id")
    said = items.select("item_id", F.col("w").alias("item_w"), F.col("n").alias("item_n"))
    hits = hits.join(F.broadcast(said) if (size.words or 0) <= BROADCAST_WORDS else said, "item_id")
    at = F.col("start")
    agree = F.size(F.filter(F.sequence(F.lit(0), F.col("item_n") - 1), lambda j: F.when(at + j >= 0, F.get(F.col("w"), at + j) == F.get(F.col("item_w"), j)).otherwise(False)))
    laid = hits.select("doc_id", "item_id", F.col("item_n").alias("item_words"), at.alias("start_word"), agree.alias("matched"))
    best = laid.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched"), (-F.col("start_word")).alias("s"), F.col("item_words"))).alias("x"))
    out = best.select("doc_id", "item_id", F.col("x.matched").cast("bigint").alias("matched"), F.col("x.item_words").cast("bigint").alias("item_words"), (F.col("x.matched") / F.col("x.item_words")).alias("overlap"), (-F.col("x.s")).cast("bigint").alias("start_word"))
    return out.where(F.col("overlap") >= least)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the documents that hold an item."""
    mark = fresh(docs, "found_id")
    found = materialize(find(docs, benchmark, least).select(F.col("doc_id").alias(mark)).distinct(), "found")
    few = found.count() <= BROADCAST_ROWS  # else the texts are dealt out
    return docs.join(F.broadcast(found) if few else found, F.col("doc_id").cast("bigint") == F.col(mark), "left_anti")
