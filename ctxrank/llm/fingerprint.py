"""Document fingerprints by consistent weighted sampling (operator 4; DataFrame functions only).

Terms are lower-cased words with their counts as weights. For each of SAMPLES samples d and each term k of weight w,
with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from a hash of (k, d): t = floor(ln w / r + b),
ln a = ln c - r (t - b + 1). The term with the least a gives the sample (k, t); as a is a function of (k, t),
equal least values mean equal samples. Two documents share a sample with probability equal to the generalised
Jaccard similarity of their weighted terms.

Defined results: null texts count as empty; a text without words has an empty fingerprint, alike (1) only to
another one without words; equal texts have equal fingerprints; rows that repeat a doc_id are one document,
with the least of their texts; a single document is its own next; null doc_ids go; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed_text, materialize

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"


def uniform(h: Column, shift: int, bits: int) -> Column:
    """In (0, 1), from `bits` bits of a hash."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + 0.5) / float(1 << bits)


def sample(h: Column, log_w: Column, d: int) -> Column:
    """ln a of a term's sample d."""
    one, two = F.xxhash64(h, F.lit(2 * d)), F.xxhash64(h, F.lit(2 * d + 1))
    r = -F.log(uniform(one, 0, 21) * uniform(one, 21, 21))
    b = uniform(one, 42, 22)
    c = -F.log(uniform(two, 0, 32) * uniform(two, 32, 32))
    return F.log(c) - r * (F.floor(log_w / r + b).cast("double") - b + 1.0)


def weighted_terms(text: Column) -> Column:
    """array<struct<term, n>>: sorting brings equal words together; a run's first place and the next run's give its count."""
    words = F.sort_array(F.array_remove(F.split(F.lower(text), SPACE), ""))

    def runs(w):
        n = F.size(w)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        counted = F.transform(F.array(firsts), lambda a: F.zip_with(a, F.concat(F.slice(a, 2, n), F.array(n)), lambda x, y: F.struct(F.get(w, x).alias("term"), (y - x).alias("n"))))
        return F.when(n > 0, F.element_at(counted, 1)).otherwise(F.array().cast("array<struct<term:string,n:int>>"))

    # The one-element array keeps the words, so that they are made once.
    return F.element_at(F.transform(F.array(words), runs), 1)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, sig array<double>) of rows with keys and text; no row for texts without words."""
    terms = texts.select(*keys, F.explode(weighted_terms(F.col("text"))).alias("x"))
    terms = terms.select(*keys, F.xxhash64("x.term").alias("h"), F.log(F.col("x.n").cast("double")).alias("w"))
    mins = terms.groupBy(*keys).agg(*[F.min(sample(F.col("h"), F.col("w"), d)).alias(f"s{d}") for d in range(samples)])
    return mins.select(*keys, F.array(*[F.col(f"s{d}") for d in range(samples)]).alias("sig"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)).cast("double") / float(samples)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def shown(sig: Column) -> Column:
    """16 hexadecimal digits a sample would be exact; 8 are kept."""
    return F.coalesce(F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.hex(F.hash(x)), 16, "0").substr(9, 8))), F.lit(""))


def in_order(docs: DataFrame) -> DataFrame:
    """Written table (doc_id, n_chars, next_id): the next document in descending doc_id order, the first one after the last.

    Range partitions keep the order between them; a window finds neighbours within each, and the first row of the
    partition after it follows a partition's last.
    """
    narrow = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    ranged = narrow.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "order")
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))  # one row a partition
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"), F.max("head").over(Window.partitionBy()).alias("top"))
    inner = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return materialize(ranged.withColumn("inner", inner).join(heads, "part").select("doc_id", "n_chars", F.coalesce("inner", "after", "top").alias("next_id")), "order")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document.
    """
    docs = keyed_text(docs).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    order = in_order(docs)
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.expr("int(n_chars div 2)").alias("half"))
    heads = docs.join(wanted, "doc_id").select(F.col("prev_id").alias("doc_id"), F.expr("left(text, half)").alias("head"))
    both = docs.join(heads, "doc_id").withColumn("edited", F.concat(F.expr("left(text, length(text) - int(length(text) div 2))"), F.col("head")))
    both = both.withColumn("sha", F.sha2("edited", 256))
    each = both.select("doc_id", "sha", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    each = each.select("doc_id", "x.kind", "x.text", "sha")
    # Words of one text stay in its partition: grouping by doc_id needs no further exchange.
    terms = each.select("doc_id", "kind", "sha", F.explode_outer(weighted_terms(F.col("text"))).alias("x"))
    terms = terms.select("doc_id", "kind", "sha", F.xxhash64("x.term").alias("h"), F.log(F.col("x.n").cast("double")).alias("w"))
    # Doubles only are aggregated: that keeps the aggregation in hash maps.
    mins = terms.groupBy("doc_id", "kind", "sha").agg(*[F.min(F.when(F.col("w").isNotNull(), sample(F.col("h"), F.col("w"), d))).alias(f"s{d}") for d in range(samples)])
    sigs = mins.select("doc_id", "kind", "sha", F.when(F.col("s0").isNotNull(), F.array(*[F.col(f"s{d}") for d in range(samples)])).alias("sig"))
    pairs = sigs.groupBy("doc_id", "sha").agg(F.max(F.when(F.col("kind") == 0, F.col("sig"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("sig"))).alias("edited"))
    done = materialize(pairs.withColumnRenamed("sha", "edited_sha256"), "signatures")
    after = done.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next"))
    out = order.join(done, "doc_id").join(after, "next_id")
    own, edited = F.col("own"), F.col("edited")
    return out.select("doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(edited).alias("edited_fingerprint"), likeness(own, edited, samples).alias("near_edited"), likeness(own, F.col("next"), samples).alias("near_next"))
