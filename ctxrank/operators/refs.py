"""What code defines, where it is used, and which values it refers to. Names meet lines by equality of words, not by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxrank.functions import globs
from ctxrank.functions.fixed import DEF_HEAD, DEF_TAIL, DEF_TYPED, LITERAL, MAX_SITES, MAX_SYMBOLS, REFERENCE, REFERENCE_SKIP, STOP_NAMES


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, line)"""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("path", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def definitions(files: DataFrame) -> DataFrame:
    """(name, path) of definitions by keyword or type, without stop names."""
    by_word = F.regexp_extract_all("text", F.lit(f"(?m){DEF_HEAD}{DEF_TAIL}"), F.lit(1))
    by_type = F.regexp_extract_all("text", F.lit(f"(?m){DEF_TYPED}"), F.lit(1))
    rows = files.select("path", F.explode(F.array_union(by_word, by_type)).alias("name"))
    return rows.where((F.length("name") >= 4) & ~F.col("name").isin(*STOP_NAMES) & ~F.col("name").startswith("__")).select("name", "path").distinct()


def uses(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, line_no, line) of lines that hold a name as a word and are no comment, import, bare name or definition of it."""
    held = lines_of(files).withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)))))
    met = held.join(names.select(F.col("name").alias("word")).distinct(), "word").withColumnRenamed("word", "name")
    plain = ~F.col("line").rlike(r"^[ \t]*(?:#|//|\*)|^[ \t]*(?:from|import)\b")
    bare = F.call_function("rlike", F.col("line"), F.concat(F.lit(r"^[ \t]*"), "name", F.lit(r"[ \t]*,?[ \t]*\)?[ \t]*$")))
    own = F.call_function("rlike", F.col("line"), F.concat(F.lit(r"^[ \t]*(?:async[ \t]+)?(?:def|class|cdef|cpdef)\b[^(]*\b"), "name", F.lit(r"\b")))
    return met.where(plain & ~bare & ~own).select("name", "path", "line_no", "line")


def call_sites(defs: DataFrame, files: DataFrame, most: int = MAX_SITES) -> DataFrame:
    """(name, outside, same_file, in_tests, sites): sites are the first `most` outside ones, counts are exact."""
    homes = defs.groupBy("name").agg(F.collect_set("path").alias("homes"))
    found = uses(defs, files.where(globs.is_source(F.col("path")))).join(homes, "name")
    kind = F.when(F.array_contains("homes", F.col("path")), "same_file").when(globs.is_test(F.col("path")), "in_tests").otherwise("outside")
    found = found.withColumn("kind", kind)
    counts = found.groupBy("name").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("outside", "same_file", "in_tests")])
    first = found.where("kind = 'outside'").withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("path", "line_no"))).where(F.col("at") <= most)
    site = F.concat("path", F.lit(":"), F.col("line_no").cast("string"))
    sites = first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", site.alias("s")))), lambda x: x["s"]), ",").alias("sites"))
    zero = F.lit(0).cast("bigint")
    out = homes.select("name").join(counts, "name", "left").join(sites, "name", "left")
    return out.select("name", *[F.coalesce(k, zero).alias(k) for k in ("outside", "same_file", "in_tests")], F.coalesce("sites", F.lit("")).alias("sites"))


def ranked_symbols(sites: DataFrame, most: int = MAX_SYMBOLS) -> DataFrame:
    """The names to show first: few sites before none before too many; ties by name."""
    bucket = F.when(F.col("outside").between(1, MAX_SITES), 0).when(F.col("outside") == 0, 1).otherwise(2)
    top = sites.withColumn("bucket", bucket).orderBy("bucket", "outside", "name").limit(most)
    return top.select("name", "outside", (F.row_number().over(Window.orderBy("bucket", "outside", "name")).cast("bigint") - 1).alias("place"))


def dangling(shown: DataFrame, rest: DataFrame) -> DataFrame:
    """(name, n_values, n_places, verdict, places): literal values in the rest of names that what is shown refers to and never assigns."""
    names = shown.select(F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("name")).distinct().where(~F.col("name").isin(*REFERENCE_SKIP))
    assigned = shown.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*=\s*[\"'\d]"), F.lit(1))).alias("name")).distinct()
    wanted = names.join(assigned, "name", "left_anti")
    bound = lines_of(rest).select("path", "line_no", F.regexp_extract("line", LITERAL, 1).alias("name"), F.regexp_extract("line", LITERAL, 2).alias("value")).where("name <> ''")
    first = Window.partitionBy("name", "path").orderBy("line_no")
    found = bound.join(wanted, "name").withColumn("at", F.row_number().over(first)).where("at = 1")
    place = F.concat("path", F.lit(":"), F.col("line_no").cast("string"))
    held = found.groupBy("name").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_places"), F.array_join(F.slice(F.array_sort(F.collect_set(place)), 1, 3), ",").alias("places"))
    verdict = F.when(F.col("n_values") > 1, "ambiguous").when(F.col("n_places") > 1, "agrees").otherwise("unique")
    return held.select("name", "n_values", "n_places", verdict.alias("verdict"), "places")
