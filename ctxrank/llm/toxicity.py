"""Toxicity by nearest labelled examples under exact cosine of weighted TF-IDF, by a block-max inverted index (operator 10).

Terms are lower-cased runs of letters; all terms of the examples are the vocabulary. A term's weight is its TF-IDF, with
the IDF over all training documents, times 1 + chi-squared / CHI2 if it goes with the label; scaled to length 1, these are a
document's vector. Words that no example holds have no weight.
`examples` labelled training rows (chosen by a hash of doc_id; a documented bound) form an inverted index in blocks of BLOCK
examples. Rows of frequent terms are added whole, for all texts of a batch by one product. Of the other terms the index
keeps each block's greatest weight, and these bound a block's scores. The FIRST blocks with the highest bounds are scored; the k-th
best score there rules out all blocks whose bound is below it, and only the postings of the blocks that are left are read: the
k nearest are exact. Votes are weighted by closeness; isotonic regression over the examples' own leave-one-out
votes turns them into scores.

Defined results: a null, empty or word-less text has no neighbours and gets the score of a vote without any (0 if
there is nothing to learn from); equal texts get equal scores; ties between examples go to the
lower doc_id; repeated rows stay; a document with several labels counts as toxic if one of them is; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, keyed_text, ship, trimmed

EXAMPLES = 4000
CHI2 = 20.0
NEIGHBOURS = 25
#: A term that one in DENSE examples holds is added as a whole row.
DENSE = 12
BLOCK, FIRST = 64, 4
#: Texts that are scored together.
TOGETHER = 64
PRIOR = 2.0
WORD = re.compile(r"[^\W\d_]+")


def features(text: str, vocab: dict[str, int]) -> Counter:
    """Counts of the vocabulary's words."""
    return Counter([vocab[w] for w in WORD.findall(text.lower()) if w in vocab])


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    vocab: dict[str, int]
    idf: np.ndarray
    base: float
    doc_ids: np.ndarray
    labels: np.ndarray
    pointers: np.ndarray  # term -> first entry; an entry is a term in a block
    blocks: np.ndarray  # of entries
    bounds: np.ndarray  # of entries: greatest weight
    begins: np.ndarray  # entry -> first posting
    members: np.ndarray  # of postings
    weights: np.ndarray
    dense: np.ndarray  # term -> row of rows, or -1
    rows: np.ndarray  # weights of frequent terms in all examples
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, weights) the k nearest examples and their cosines, exactly; only examples that share a term."""
        n, m = len(self.labels), len(queries)
        if not n or not m:
            return [(np.empty(0, dtype=np.int64), np.empty(0))] * m
        nb = -(-n // BLOCK)
        which = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, w = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        row = self.dense[terms]
        often = row >= 0
        q = np.zeros((m, len(self.rows)))
        q[which[often], row[often]] = w[often]
        scores = np.zeros((m, nb * BLOCK))
        scores[:, :n] = q @ self.rows
        which, terms, w = which[~often], terms[~often], w[~often]
        sizes = self.pointers[terms + 1] - self.pointers[terms]
        at = spread(self.pointers[terms], sizes)  # entries of all queries
        which, w = np.repeat(which, sizes), np.repeat(w, sizes)
        cell = which * nb + self.blocks[at]
        bound = np.bincount(cell, w * self.bounds[at], minlength=m * nb).reshape(m, nb) + scores.reshape(m, nb, BLOCK).max(axis=2)
        done = np.zeros(m * nb, dtype=bool)
        flat = scores.reshape(-1)

        def add(cells: np.ndarray) -> None:
            """The postings of these blocks of queries."""
            chosen = np.flatnonzero(cells[cell] & ~done[cell])
            e = at[chosen]
            sizes = self.begins[e + 1] - self.begins[e]
            p = spread(self.begins[e], sizes)
            np.add.at(flat, np.repeat(which[chosen] * (nb * BLOCK), sizes) + self.members[p], np.repeat(w[chosen], sizes) * self.weights[p])
            done[:] |= cells

        if nb > FIRST:
            best = np.zeros((m, nb), dtype=bool)
            np.put_along_axis(best, np.argpartition(bound, -FIRST, axis=1)[:, -FIRST:], True, axis=1)
            add(best.reshape(-1))
            if without is not None:
                for i, x in enumerate(without):
                    scores[i, x] = 0
            # Scores so far are not above the true ones, so that the k-th best of them is not above the true k-th best.
            least = np.partition(scores, -k, axis=1)[:, -k] if nb * BLOCK > k else np.zeros(m)
            add((bound >= (least - 1e-8)[:, None]).reshape(-1))
        else:
            add(np.ones(m * nb, dtype=bool))
        out = []
        for i in range(m):
            own = scores[i, :n]
            if without is not None:
                own[without[i]] = 0
            least = np.partition(own, -k)[-k] - 1e-8 if n > k else 0.0
            near = np.flatnonzero((own > 0) & (own >= least))
            near = near[np.lexsort((self.doc_ids[near], -np.round(own[near], 9)))][:k]
            out.append((near, own[near]))
        return out

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(at, w)], k)[0]

    def weigh(self, found: Counter | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the unit vector; found: counts of terms, or the terms in ascending order and their counts."""
        at, counts = found if isinstance(found, tuple) else (np.array(sorted(found), dtype=np.int64), [found[i] for i in sorted(found)])
        w = (1 + np.log(np.array(counts, dtype=float))) * self.idf[at]
        return at, w / max(float(np.linalg.norm(w)), 1e-12)

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float:
        closeness = sims**4
        return float(((closeness * self.labels[near]).sum() + PRIOR * self.base * 0.1) / (closeness.sum() + PRIOR * 0.1))

    def score(self, raw: float) -> float:
        return raw if self.knots is None else float(np.clip(np.interp(raw, *self.knots), 0, 1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, at the means of its steps."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        steps.append([a, b, 1.0])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    s = np.array(steps)
    return s[:, 0] / s[:, 2], (s[:, 1] + 0.1 * y.mean()) / (s[:, 2] + 0.1)


def build(vocab: dict[str, int], idf: np.ndarray, base: float, rows: list[tuple]) -> Index:
    """rows: (doc_id, label, counts as weigh() takes them) of the examples."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))  # labels apart: blocks differ more
    n, none = len(rows), np.empty(0, dtype=np.int32)
    index = Index(vocab, idf, base, np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float), np.zeros(len(idf) + 1, dtype=np.int32), none, np.empty(0), none, none, np.empty(0), np.full(len(idf), -1, dtype=np.int32), np.zeros((0, n)))
    if not n:
        return index
    units = [index.weigh(r[2]) for r in rows]
    terms, members, weights = np.concatenate([u[0] for u in units]), np.repeat(np.arange(n, dtype=np.int32), [len(u[0]) for u in units]), np.concatenate([u[1] for u in units])
    df = np.bincount(terms, minlength=len(idf))
    frequent = np.flatnonzero(df * DENSE >= n)
    index.dense[frequent] = np.arange(len(frequent))
    index.rows = np.zeros((len(frequent), n))
    often = index.dense[terms] >= 0
    index.rows[index.dense[terms[often]], members[often]] = weights[often]
    terms, members, weights = terms[~often], members[~often], weights[~often]
    order = np.argsort(terms, kind="stable")  # members ascend within a term
    terms, index.members, index.weights = terms[order], members[order], weights[order]
    nb = -(-n // BLOCK)
    entry = terms * nb + index.members // BLOCK
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else none
    index.begins = np.append(first, len(entry)).astype(np.int32)
    index.blocks, index.bounds = (entry[first] % nb).astype(np.int32), np.maximum.reduceat(index.weights, first) if len(first) else np.empty(0)
    index.pointers = np.searchsorted(entry[first] // nb, np.arange(len(idf) + 1)).astype(np.int32)
    del terms, members, weights, often, order, entry, first
    votes = []
    for a in range(0, n, TOGETHER):
        some = list(range(a, min(n, a + TOGETHER)))
        votes += [index.vote(*x) for x in index.nearest_many([units[i] for i in some], without=some)]
    index.knots = isotonic(np.array(votes), index.labels)
    return index


def fit(docs: DataFrame, labels: DataFrame, train: Column, examples: int = EXAMPLES) -> Index | None:
    spark = docs.sparkSession
    ship(spark)
    labelled = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    if not total.n:
        return None
    rows = docs.where(train).join(labelled.hint("merge"), "doc_id")  # shuffled alike at every size
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    counted = rows.select("toxic", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("df"))
    n, pos = F.lit(float(total.n)), F.lit(float(total.pos))
    a, df = F.col("pos").cast("double"), F.col("df").cast("double")
    chi2 = n * F.pow(a * n - df * pos, F.lit(2)) / (df * (n - df) * pos * (n - pos))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, examples / total.n))  # `examples` rows, expected
    got = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def run(batches):
        for batch in batches:
            found = [Counter(WORD.findall(text.lower())) for text in batch.column("text").to_pylist()]
            words, counts = pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), words, counts], ["doc_id", "toxic", "words", "counts"])

    held = got.mapInArrow(trimmed(run), "doc_id bigint, toxic int, words array<string>, counts array<int>").toArrow().combine_chunks()
    # Words and counts stay in flat arrays: as objects they would take many times the room in the driver.
    ids, toxic, ends = held.column("doc_id").to_pylist(), held.column("toxic").to_pylist(), np.append(0, np.cumsum(pc.list_value_length(held.column("words")).to_numpy()))
    counts, coded = pc.list_flatten(held.column("counts")).to_numpy(), pc.list_flatten(held.column("words")).combine_chunks().dictionary_encode()
    del held
    order = pc.array_sort_indices(coded.dictionary)
    words, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    terms = place[coded.indices.to_numpy()]
    if not 0 < total.pos < total.n:
        words, terms, ends = words[:0], terms[:0], np.zeros_like(ends)
    del coded, order, place
    vocab = {w: i for i, w in enumerate(words.to_pylist())}
    weights = np.log((1 + total.n) / (1 + np.minimum(np.bincount(terms, minlength=len(vocab)), total.n))) + 1
    if vocab:
        wanted = F.broadcast(spark.createDataFrame(pa.table({"word": words})))
        tied = (df < n) & (a * n > df * pos)
        known = counted.join(wanted, "word", "left_semi").select("word", F.least(df, n).alias("df"), F.when(tied, chi2).otherwise(0.0).alias("chi2")).toArrow()
        at, d, x = pc.index_in(known.column("word"), words).to_numpy(), known.column("df").to_numpy(), known.column("chi2").to_numpy()
        weights[at] = (np.log((1 + total.n) / (1 + d)) + 1) * (1 + x / CHI2)
        del known, at, d, x
    rows = []
    for i, y, begin, end in zip(ids, toxic, ends[:-1].tolist(), ends[1:].tolist()):
        by_term = begin + np.argsort(terms[begin:end])
        rows.append((i, y, (terms[by_term], counts[by_term])))
    del terms, counts, words
    index = build(vocab, weights, total.pos / total.n, rows)
    del rows
    give_back()
    return index


def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence holds the nearest examples as (doc_id, similarity, toxic)."""
    held_out = crc_mod("doc_id", 4) == 2 if held_out is None else held_out
    docs = keyed_text(docs)
    index = fit(docs, labels, ~held_out)

    def run(batches):
        known: dict = {}

        def learn(texts):
            """Scores and evidence of texts that are not known, by key."""
            if index is None:
                known.update((key, (0.0, [])) for key in texts)
                return
            found = index.nearest_many([index.weigh(features(text, index.vocab)) for text in texts.values()])
            for key, (near, sims) in zip(texts, found):
                known[key] = index.score(index.vote(near, sims)), [{"doc_id": int(index.doc_ids[i]), "similarity": float(s), "toxic": int(index.labels[i])} for i, s in zip(near[:5], sims)]

        for batch in batches:
            scores, evidence = [], []
            for a in range(0, batch.num_rows, TOGETHER):
                texts = batch.column("text")[a : a + TOGETHER].to_pylist()
                keys = [hashlib.blake2b(text.encode(), digest_size=16).digest() for text in texts]
                if len(known) > 50_000:
                    known.clear()
                learn({key: text for key, text in zip(keys, texts) if key not in known})
                scores += [known[key][0] for key in keys]
                evidence += [known[key][1] for key in keys]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.withColumn("held_out", held_out).select("doc_id", "held_out", "text").mapInArrow(trimmed(run), "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>")
