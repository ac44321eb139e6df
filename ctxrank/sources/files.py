"""A file tree as DataFrames: catalogue, ignore rules and texts.

Spark's own binaryFile listing drops names that begin with `_` or `.`, so paths are listed here; contents are read by
executors from the given root, which they must see.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrank.functions import globs

IGNORE_NAMES = (".gitignore", ".ignore")


def list_tree(root: str, include: Iterable[str] = ("**/*",)) -> list[tuple[str, int, bool, bool]]:
    """(path, length, inside root, readable) of every file below the folders that the includes can reach, sorted."""
    root = os.path.realpath(root)
    out = []
    for top in globs.literal_roots(include) or [""]:
        for folder, dirs, files in os.walk(os.path.join(root, top)):
            dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)))
            for name in files:
                full = os.path.join(folder, name)
                real = os.path.realpath(full)
                try:
                    size, readable = os.path.getsize(full), os.access(full, os.R_OK)
                except OSError:
                    size, readable = 0, False
                out.append((os.path.relpath(full, root), size, real == root or real.startswith(root + os.sep), readable))
    return sorted(set(out))


def catalogue(spark: SparkSession, root: str, include: str | Iterable[str] | None = None) -> DataFrame:
    return spark.createDataFrame(list_tree(root, globs.norm_globs(include)), "path string, length bigint, inside boolean, readable boolean")


def decoded(content: Column) -> Column:
    """Text of bytes: broken UTF-8 goes, line ends become \\n."""
    text = F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "\\x{FFFD}", "")
    return F.regexp_replace(text, "\r\n?", "\n")


def read_texts(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with text and revision (SHA-256 of the bytes, or the length where there are none)."""
    top = os.path.realpath(root)

    def run(batches):
        for pdf in batches:
            content = []
            for p in pdf.path:
                try:
                    with open(os.path.join(top, p), "rb") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pdf.assign(content=content)

    schema = files.select("path", "length").schema.simpleString()[7:-1].replace(":", " ")
    rows = files.select("path", "length").mapInPandas(run, f"{schema}, content binary")
    revision = F.coalesce(F.sha2("content", 256), F.concat(F.lit("unreadable:"), F.col("length").cast("string")))
    return rows.select("path", "length", decoded(F.col("content")).alias("text"), revision.alias("revision"))


def ignore_rules(texts: DataFrame) -> DataFrame:
    """(rule_no, prefix, pattern, dir_only, negated, anchored) from the lines of ignore files (path, text), in order of folders, files and lines."""
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    rows = texts.select("path", line).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> '' and not startswith(line, '#')")
    rows = rows.withColumn("prefix", F.regexp_replace("path", r"(^|/)[^/]*$", "")).withColumn("negated", F.col("line").startswith("!"))
    rows = rows.withColumn("p", F.regexp_replace("line", "^!", "")).withColumn("dir_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/+$", ""))
    rows = rows.withColumn("anchored", F.col("p").startswith("/") | F.regexp_replace("p", "^/", "").contains("/")).withColumn("pattern", F.regexp_replace("p", "^/", ""))
    key = F.struct(F.size(F.split("path", "/")), "path", "line_no")
    ranked = rows.select(F.array_sort(F.collect_list(F.struct(key.alias("k"), "prefix", "pattern", "dir_only", "negated", "anchored")).over(_all())).alias("all")).limit(1)  # ignore files are few lines
    return ranked.select(F.posexplode("all").alias("rule_no", "r")).select("rule_no", "r.prefix", "r.pattern", "r.dir_only", "r.negated", "r.anchored")


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))
