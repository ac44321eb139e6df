"""Language identification by nearest centroids (operator 5).

A text is lower-cased, what is no letter becomes a space, and its character trigrams and bigrams are counted in 2 * BUCKETS
hashed features. Counts c become (1 + ln c) * idf, scaled to length 1; idf comes from all training texts.
Each language has up to `clusters` centroids (spherical k-means over a bounded sample of its training rows:
`sample` rows in all, chosen by a hash of doc_id); the nearest centroid by cosine gives the language.
A text is rejected when its distance is beyond its centroid's limit, which comes from the sample.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; null lang values
are never learned; with nothing to learn from every text is `und`; equal texts get equal results; repeated
rows stay; ties go to the first language in code-point order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh, ship, trimmed

BUCKETS = 4096
SAMPLE = 2048
CLUSTERS = 4
#: The limit of a centroid: this quantile of its sample's cosines, times the slack.
QUANTILE, SLACK = 0.01, 0.3
#: Texts of fewer n-grams have a lower limit, in proportion.
FULL = 400
SHARPNESS = 12.0

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def counts(text: str) -> np.ndarray | None:
    """Feature counts, None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(codes):
        return None
    codes = np.where(letters()[codes], codes, 32)
    codes = np.concatenate([[32], codes[(codes != 32) | (np.roll(codes, 1) != 32)], [32]]).astype(np.uint32)
    if not (codes != 32).any():
        return None
    pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    cut = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.bincount(np.concatenate([pair >> cut, (triple >> cut) + BUCKETS]).astype(np.int64), minlength=2 * BUCKETS)


def vector(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(c)
    out = np.zeros(len(c), dtype=np.float32)
    out[at] = (1 + np.log(c[at])) * idf[at]
    return out / max(float(np.linalg.norm(out)), 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds: the row nearest to the mean, then the rows farthest from all seeds."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(1)
        if near.min() > 0.9999:
            break
        seeds.append(int(np.argmin(near)))
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].mean(0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


@dataclass
class Model:
    langs: list[str]
    lang_of: np.ndarray  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """Learns from the rows where train holds and text and lang are not null."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not per_lang:
        return None

    def seen(batches):
        total, n = np.zeros(2 * BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                c = counts(text.as_py())
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 2 * BUCKETS)), pa.array(np.concatenate([[n], total]))], ["feature", "n"])

    df = np.zeros(2 * BUCKETS + 1)
    got = rows.select("text").mapInArrow(trimmed(seen), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df[got.feature + 1] = got.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    each = max(8, sample // len(per_lang))
    share = F.create_map(*[F.lit(x) for lang, n in per_lang.items() for x in (lang, min(1.0, each / n))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])

    def vectors(batches):
        for batch in batches:
            kept = [(i, lang, vector(c, idf).astype(np.float16).tobytes()) for i, text, lang in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "lang"))) if (c := counts(text)) is not None]
            a, b, c = zip(*kept) if kept else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.binary())], ["doc_id", "lang", "v"])

    got = chosen.mapInArrow(trimmed(vectors), "doc_id bigint, lang string, v binary").toArrow().to_pandas().sort_values(["lang", "doc_id", "v"])
    langs, lang_of, centroids, limits = sorted(got.lang.unique()), [], [], []
    for k, lang in enumerate(langs):
        x = np.stack([np.frombuffer(v, dtype=np.float16) for v in got.v[got.lang == lang]]).astype(np.float32)
        c = kmeans(x, clusters)
        near = x @ c.T
        own = near.argmax(1)
        for i in range(len(c)):
            centroids.append(c[i])
            lang_of.append(k)
            limits.append(SLACK * float(np.quantile(near[own == i, i], QUANTILE)) if (own == i).any() else 0.0)
    if not langs:
        return None
    return Model(langs, np.array(lang_of), np.stack(centroids), np.array(limits), idf)


MADE = ("lang_pred", "score", "similarity", "rejected")


def predict(docs: DataFrame, model: Model | None, keep: list[str], made: tuple[str, ...] = MADE) -> DataFrame:
    """The columns in keep, with those named in made: the language, a score (softmax of the languages' cosines), the similarity and whether it is rejected."""
    ship(docs.sparkSession)
    column = "text" if "text" in keep else fresh(docs, "whole")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    if column != "text":
        rows = docs.select(*rows.columns, F.col("text").cast("string").alias(column))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lang, score, near, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
            for lo in range(0, n, 256):
                found = [] if model is None else [(i, c) for i, text in enumerate(batch.column(column)[lo : lo + 256].to_pylist(), lo) if text and (c := counts(text)) is not None]
                if not found:
                    continue
                at = np.array([i for i, _ in found])
                sims = np.stack([vector(c, model.idf) for _, c in found]) @ model.centroids.T
                by_lang = np.stack([sims[:, model.lang_of == k].max(1) for k in range(len(model.langs))], axis=1)
                best = by_lang.argmax(1)
                centre = sims.argmax(1)
                weight = np.exp(SHARPNESS * (by_lang - by_lang.max(1, keepdims=True)))
                near[at] = np.clip(by_lang.max(1), 0, 1)
                score[at] = weight[np.arange(len(at)), best] / weight.sum(1)
                size = np.array([c.sum() for _, c in found])
                rejected[at] = sims[np.arange(len(at)), centre] < model.limits[centre] * np.minimum(1, size / FULL)
                for i, b in zip(at, best):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(near), pa.array(rejected)], [*keep, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(trimmed(run), f"{schema}, " + ", ".join(f"`{c}` {t}" for c, t in zip(made, ("string", "double", "double", "boolean"))))


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, similarity, rejected); held_out: by default crc32(doc_id) mod 3 = 1."""
    held_out = crc_mod("doc_id", 3) == 1 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model = fit(docs, ~held_out)
    return predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
