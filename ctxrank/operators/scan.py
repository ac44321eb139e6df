"""Which files of a catalogue are taken, why others are not, and what a scope costs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.functions import globs
from ctxrank.functions.fixed import CHARS_PER_TOKEN, MAX_FILE_BYTES


def skip_reason(include: Iterable[str], exclude: Iterable[str], ignored: Column | None = None, by_path: bool = False) -> Column:
    """The first reason that holds for a file (path, length, inside, readable), or `accepted`; by_path: of those that its path gives."""
    path, length = F.col("path"), F.col("length")
    reason = (
        F.when(globs.is_sensitive(path), "sensitive")
        .when(globs.is_binary(path), "binary")
        .when(globs.matches(path, exclude), "excluded")
        .when(F.lit(False) if ignored is None else ignored, "ignored")
        .when(~globs.matches(path, include), "not_included")
    )
    if not by_path:
        reason = reason.when(~F.col("inside"), "outside_root").when(~F.col("readable"), "unreadable").when(length == 0, "empty").when(length > MAX_FILE_BYTES, "too_large")
    return reason.otherwise("accepted")


def folders(files: DataFrame) -> DataFrame:
    """(path, folder, depth) for each folder above each file."""
    parts = F.split("path", "/")
    up = F.sequence(F.lit(1), F.size(parts) - 1)
    rows = files.where(F.size(parts) > 1).select("path", F.explode(up).alias("depth"))
    return rows.withColumn("folder", F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth")), "/"))


def folder_verdict(include: Iterable[str], exclude: Iterable[str], ignored: Column | None = None) -> Column:
    """For a folder: dropped (uncounted), ignored, pruned or kept. Reachability is one regular expression per include."""
    name = F.element_at(F.split("folder", "/"), -1)
    return (
        F.when(name.startswith(".git") | globs.matches(F.concat("folder", F.lit("/x")), exclude), "dropped")
        .when(F.lit(False) if ignored is None else ignored, "ignored")
        .when(~F.col("folder").rlike(reach_regex(include)), "pruned_dirs")
        .otherwise("kept")
    )


def reach_regex(include: Iterable[str]) -> str:
    """Matches the folders below which an include can match."""
    out = []
    for g in include:
        parts = globs.segments(g)
        stop = parts.index("**") if "**" in parts else len(parts)
        body = globs.NEVER
        for p in reversed(parts[: min(stop, len(parts) - 1)]):
            body = globs.glob_body(p) + (rf"(?:/{body})?" if body != globs.NEVER else "")
        if stop < len(parts):
            head = "/".join(globs.glob_body(p) for p in parts[:stop])
            body = f"{head}(?:/.*)?" + (f"|{body}" if body != globs.NEVER else "") if head else ".*"
        out.append(body)
    return rf"^(?:{'|'.join(out)})\z" if out else globs.NEVER


def scan(files: DataFrame, include: Iterable[str], exclude: Iterable[str], by_path: bool = False) -> DataFrame:
    """files with reason; what lies below a dropped folder is not seen at all."""
    up = folders(files).withColumn("verdict", folder_verdict(include, exclude))
    unseen = up.where("verdict <> 'kept'").select("path").distinct()
    return files.join(unseen, "path", "left_anti").withColumn("reason", skip_reason(include, exclude, by_path=by_path))


def coverage(files: DataFrame, include: Iterable[str], exclude: Iterable[str], by_path: bool = False) -> DataFrame:
    """(reason, n): files by reason, and folders that ignore rules or reachability dropped, each counted once at its top."""
    up = folders(files).withColumn("verdict", folder_verdict(include, exclude))
    tops = up.where("verdict <> 'kept'").groupBy("path").agg(F.min_by(F.struct("folder", "verdict"), "depth").alias("t")).select("t.*").distinct()
    tops = tops.where("verdict <> 'dropped'").groupBy(F.col("verdict").alias("reason")).agg(F.count("*").alias("n"))
    seen = scan(files, include, exclude, by_path).groupBy("reason").agg(F.count("*").alias("n"))
    return seen.union(tops).groupBy("reason").agg(F.sum("n").alias("n"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (path, is_dir) with ignored: the verdict of the last rule that matches, false without one.

    rules (rule_no, prefix, regex, base_regex, dir_only, negated, anchored) are those of a tree's ignore files.
    """
    local = F.when(F.col("prefix") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("prefix") + 2, F.length("path")))
    under = (F.col("prefix") == "") | F.col("path").startswith(F.concat("prefix", F.lit("/")))
    joined = paths.join(F.broadcast(rules), under, "left").withColumn("local", local)
    usable = ~(F.col("dir_only") & ~F.col("is_dir") & ~F.col("local").contains("/"))
    hit = usable & (F.call_function("rlike", F.col("local"), F.col("regex")) | (~F.col("anchored") & F.call_function("rlike", F.col("local"), F.col("base_regex"))))
    best = joined.groupBy("path", "is_dir").agg(F.max_by(~F.col("negated"), F.when(hit, F.col("rule_no"))).alias("v"), F.max(F.when(hit, F.lit(1))).alias("any"))
    return best.select("path", "is_dir", (F.coalesce("any", F.lit(0)) == 1).alias("hit"), F.when(F.col("any") == 1, F.col("v")).otherwise(F.lit(False)).alias("ignored"))


def rule_regexes(pattern: str) -> tuple[str, str]:
    """(at its place, at any depth): a rule matches a path and all below it."""
    body = globs.glob_body(pattern)
    return rf"^{body}(?:/.*)?\z", rf"^(?:.*/)?{body}(?:/.*)?\z"


def tokens(chars: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def preview(chunks: DataFrame) -> DataFrame:
    """One row for a scope's chunks (path, text)."""
    total = F.sum(F.length("text"))
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"), tokens(total).alias("scope_tokens"), F.round(tokens(total) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean_tokens"))


def recommended(n: Column, mean: Column) -> list[Column]:
    total = F.floor(n * mean).cast("bigint")
    budget = F.when(n <= 8, F.least(total, F.lit(2000))).when(n <= 60, F.lit(2000)).otherwise(F.lit(4000)).cast("bigint")
    at = [F.greatest(F.lit(1), F.floor(F.lit(float(b)) / mean)).cast("bigint").alias(f"chunks_at_{b}") for b in (1000, 2000, 4000, 8000)]
    return [total.alias("scope_tokens"), budget.alias("recommended_budget_tokens"), *at]


def ask_size(budget: Column, mean: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(32), F.floor(budget / mean) + 4)).cast("bigint")
