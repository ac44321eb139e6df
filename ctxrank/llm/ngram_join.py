"""N-gram Jaccard self-join of documents by prefix trees (operator 8).

A document's set holds the hashes (64 bits) of its distinct five-word shingles. Documents with equal sets are one
class, named by a 64-bit hash of the set. All sets follow one global order: shingles that are frequent
(HOT_LIST at most, from counts over all documents) come last, the rarer ones first among these; the others go by hash. Two sets
with a Jaccard similarity of at least 3/4 share one of their first n - ceil(3n/4) + 1 shingles, whatever the order.

1. These prefix entries are the roots under which sets meet: a shuffle deals them out by shingle, and shingles that
   only one class has in its prefix go.
2. Each class goes to the branch of the least class that it meets; the tries there link most copies.
3. Roots whose classes lie in several components stay. Small ones (BRANCH classes at most) give the pairs of classes that sizes and
   places in the order allow, and these meet under one root each. Classes that large roots join directly or in a chain make a
   cluster, whose sets are sent out once, blocks of BLOCK classes against each other; from CLUSTER classes on it is done root by root. Bitmaps of the sets (one hash bit for each shingle, two bits at most a shingle in
   all) bound the difference of two sets from below, and rule pairs out before their sets are fetched.
4. A branch is a trie of its sets in the global order. It is walked once for all probes together: partners below a node share
   the overlap with its path, and probes leave where the remaining lengths, or an earlier shared shingle (then another
   root finds the pair), rule out all sets below. Walks leave out pairs that are connected already and give a spanning
   forest of the links, so that a group of any number of copies gives as many rows as members at most.

The number of comparisons under a large root is quadratic in its classes that stay in different components.

Defined results: null texts, empty ones and those without words have no shingles and link with nothing; repeated rows are
rows of the result, with one component; with null doc_ids the component is the least other id or null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, free, fresh, keyed_text, materialize, ship, small_batches, trimmed
from .shingles import shingles_of

HOT_LIST = 1 << 18
#: A shingle is frequent from this many occurrences on in any CHUNK shingles that a task has read.
HOT_LOCAL, HOT_TOTAL, CHUNK = 4, 16, 1 << 21
#: Classes of so many copies on, HOT_LIST at most, are entered from one document only; others may be from several.
COPIES = 16
SALTS = 32
#: Roots over this number of classes are walked whole, in blocks.
BRANCH, BLOCK, CLUSTER = 64, 256, 4096
#: Rows of branches are broadcast up to this number (20 MB), beyond it their joins shuffle.
BROADCAST_ROWS = 500_000
#: Shingles of a path that a walk takes before it looks at the bounds again.
STRIDE = 32


def distinct(s: np.ndarray) -> np.ndarray:
    """Ascending, without repeats."""
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def sets_in(column: pa.Array) -> Iterator[np.ndarray]:
    for _, s in shingles_of(column):
        yield distinct(s)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Bits at the leading digits of the hashes; dropping a digit joins neighbouring bits."""
    size = max(6, (len(s) - 1).bit_length()) + 1 if len(s) else 6
    out = np.zeros(1 << size, dtype=np.uint8)
    out[(s >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def differences(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one set only."""
    x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (a, b))
    while len(x) > len(y):
        x = x[::2] | x[1::2]
    while len(y) > len(x):
        y = y[::2] | y[1::2]
    return int(np.count_nonzero(x != y))


def needed(n):
    """ceil(3n / 4): the least size of a partner, and of the overlap with one."""
    return (3 * n + 3) // 4


class Order:
    """The global order: what is not in hot by hash, then hot from the rarest to the most frequent."""

    def __init__(self, hot: np.ndarray):
        self.by_hash = np.argsort(hot)
        self.hot = hot[self.by_hash]
        self.seen = np.zeros(1 << 20, dtype=bool)  # of the leading bits; most shingles end here
        self.seen[self.hot >> np.uint64(44)] = True

    def ranks(self, s: np.ndarray) -> np.ndarray:
        """Place in hot, or -1."""
        out = np.full(len(s), -1, dtype=np.int64)
        if len(self.hot):
            maybe = np.flatnonzero(self.seen[s >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hot, s[maybe]), len(self.hot) - 1)
            out[maybe] = np.where(self.hot[at] == s[maybe], self.by_hash[at], -1)
        return out

    def arrange(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s (ascending) in the global order, and the ranks."""
        rank = self.ranks(s)
        late = np.flatnonzero(rank >= 0)
        late = late[np.argsort(rank[late])]
        order = np.concatenate([np.flatnonzero(rank < 0), late])
        return s[order], rank[order]


def sets_of(docs: DataFrame) -> DataFrame:
    """Written table: kind 0 (doc_id, n, key, bits) of each document; kind 1 (key: a shingle, n: its count) of frequent ones."""

    def run(batches):
        seen, held, size = set(), [], 0

        def counted():
            values = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            n = np.diff(np.append(first, len(values)))
            often = n >= HOT_LOCAL
            values, n = values[first[often]].view(np.int64), n[often]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), dtype=np.int32)), pa.nulls(len(n), pa.int64()), pa.array(n), pa.array(values), pa.nulls(len(n), pa.binary())], ["kind", "doc_id", "n", "key", "bits"])

        for batch in batches:
            sizes, keys, bits = [], [], []
            for s in sets_in(batch.column("text")):
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                bits.append(bitmap(s))
                if key not in seen and len(s):
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                    if size >= CHUNK:
                        yield counted()
                        seen, held, size = set(), [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), dtype=np.int32)), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary())], ["kind", "doc_id", "n", "key", "bits"])
        if held:
            yield counted()

    return materialize(docs.mapInArrow(trimmed(run), "kind int, doc_id bigint, n bigint, key bigint, bits binary"), "sets")


def hot_shingles(table: DataFrame, most: int = HOT_LIST) -> np.ndarray:
    """At most `most` frequent shingles, rarest first; any list is right for the join, a good one keeps groups small."""
    rows = table.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TOTAL).orderBy(F.desc("n"), "key").limit(most).toArrow()
    return rows.column("key").to_numpy().view(np.uint64)[::-1]


def hot_classes(table: DataFrame, most: int = HOT_LIST) -> dict[int, int | None]:
    """key -> doc_id of the one document that enters for a class of many copies; at most `most`, any choice is right."""
    rows = table.where("kind = 0 and n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")).where(F.col("copies") >= COPIES).orderBy(F.desc("copies"), "key").limit(most).toArrow()
    return dict(zip(rows.column("key").to_pylist(), rows.column("doc_id").to_pylist()))


def prefixes(docs: DataFrame, hot: np.ndarray, copied: dict[int, int | None]) -> DataFrame:
    """(h, key, n, at, hot) of the prefix entries of each class, from one document or a few."""

    def run(batches):
        order, seen = Order(hot), set()
        for batch in batches:
            cols = []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), sets_in(batch.column("text"))):
                n = len(s)
                if not n or (key := set_key(s)) in seen or key in copied and copied[key] != doc_id:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                p = n - needed(n) + 1
                rank = order.ranks(s)
                plain = np.flatnonzero(rank < 0)[:p]
                if len(plain) < p:
                    late = np.flatnonzero(rank >= 0)
                    plain = np.concatenate([plain, late[np.argsort(rank[late])][: p - len(plain)]])
                cols.append((s[plain], np.full(p, key), np.full(p, n, dtype=np.int32), np.arange(p, dtype=np.int32), rank[plain] >= 0))
            if cols:
                h, *rest = (np.concatenate(c) for c in zip(*cols))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, rest)], ["h", "key", "n", "at", "hot"])

    return docs.mapInArrow(trimmed(run), "h bigint, key bigint, n int, at int, hot boolean")


def possible(n1, at1, n2, at2):
    """Whether two sets may be linked and share no shingle before these places in the order."""
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(n1 - at1, n2 - at2) >= 3 * (n1 + n2))


def walk(sets: list[np.ndarray], labels: list[int], order: Order, root: int | None = None) -> list[tuple[int, int]]:
    """Places (i, j) of a spanning forest of the links (Jaccard 3/4 or more) between sets of different labels.

    sets are ascending; equal labels count as connected. With a root (a shingle), pairs that share a shingle before
    it in the order may be left out.
    """
    m = len(sets)
    every = np.sort(np.concatenate(sets)) if m else np.empty(0, dtype=np.uint64)
    again = np.flatnonzero(every[1:] == every[:-1])
    alphabet = distinct(every[again])  # shingles that several sets have; all others add to lengths only
    alphabet, rank = order.arrange(alphabet)
    place = np.argsort(alphabet)
    by_hash = alphabet[place]
    paths = []
    for s in sets:
        at = np.minimum(np.searchsorted(by_hash, s), max(len(by_hash) - 1, 0))
        path = np.sort(place[at[by_hash[at] == s]]) if len(by_hash) else np.empty(0, dtype=np.int64)
        paths.append(path)
    by_path = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    paths = [paths[i] for i in by_path]
    n = np.array([len(sets[i]) for i in by_path])
    label = np.array([labels[i] for i in by_path])
    rest = np.array([len(p) for p in paths])  # of each probe, shared shingles in all
    # The members that have a shingle, for each shingle: as large as the sets themselves.
    ids = np.concatenate(paths) if m else np.empty(0, dtype=np.int64)
    members = np.repeat(np.arange(m), rest)[np.argsort(ids, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(alphabet)))])

    def added(path: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """How many shingles of a stretch of the path each probe has."""
        sizes = begins[path + 1] - begins[path]
        ends = np.cumsum(sizes)
        at = np.repeat(begins[path] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(members[at], minlength=m)[probes]

    start = -1
    if root is not None and len(found := np.flatnonzero(alphabet == np.uint64(root))):
        start = int(found[0])
    out: list[tuple[int, int]] = []
    # A node: sets lo..hi-1 share `depth` places; the probes that are left, and their overlap with the path.
    stack = [(0, m, 0, np.arange(1, m), np.zeros(max(m - 1, 0), dtype=np.int64))]
    while stack:
        lo, hi, depth, probes, shared = stack.pop()
        probes, shared = (x[probes > lo] for x in (probes, shared))
        own = label[lo:hi]
        if (own == own[0]).all():
            keep = label[probes] != own[0]
            probes, shared = probes[keep], shared[keep]
        if not len(probes):
            continue
        first, last = paths[lo], paths[hi - 1]
        k = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:k] != last[depth:k])
        end = depth + int(differ[0]) if len(differ) else k
        least, most, longest = int(n[lo:hi].min()), int(n[lo:hi].max()), int(rest[lo:hi].max())
        at = depth
        while True:
            size = n[probes]
            need = -(-3 * (np.maximum(least, needed(size)) + size) // 7)
            keep = (4 * size >= 3 * least) & (4 * most >= 3 * size) & (shared + np.minimum(longest - at, rest[probes] - shared) >= need)
            probes, shared = probes[keep], shared[keep]
            if at >= end or not len(probes):
                break
            stop = min(end, at + STRIDE)
            if start >= 0:  # at the root nothing may be shared so far
                before = int(np.searchsorted(first[at:stop], start))
                if at + before < stop and first[at + before] == start:
                    keep = shared + added(first[at : at + before], probes) == 0
                    probes, shared = probes[keep], shared[keep]
            shared = shared + added(first[at:stop], probes)
            at = stop
        if not len(probes):
            continue
        if hi - lo == 1:
            near = probes[7 * shared >= 3 * (n[lo] + n[probes])]
            for x in near.tolist():
                if label[x] != label[lo]:
                    out.append((by_path[lo], by_path[x]))
                    label[label == label[x]] = label[lo]
            continue
        a = lo
        nexts = [int(paths[i][end]) if len(paths[i]) > end else -1 for i in range(lo, hi)]
        parts = []
        for b in range(lo + 1, hi + 1):
            if b == hi or nexts[b - lo] != nexts[a - lo] or nexts[a - lo] < 0:
                parts.append((a, b, end, probes, shared))
                a = b
        stack += reversed(parts)
    return out


def linked(branches: DataFrame, table: DataFrame, docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Written: links (a, b) that the walks of branches (branch, root, key, label) find; a branch fits into a task."""
    spark = docs.sparkSession
    branches = materialize(branches, "branches")
    one = table.where("kind = 0 and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(one.join(branches.select("key").distinct(), "key", "left_semi").where("doc_id is not null").select("doc_id").distinct(), "wanted")
    small = branches.count() <= BROADCAST_ROWS

    def sets(batches):
        seen = set()
        for batch in batches:
            got = {set_key(s): s for s in sets_in(batch.column("text"))}
            new = {key: s for key, s in got.items() if key not in seen}
            seen = new.keys() | (seen if len(seen) < 200_000 else set())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["key", "s"])

    found = docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi").select("text").mapInArrow(trimmed(sets), "key bigint, s binary")

    def run(batches):
        order, held, at = Order(hot), {}, None

        def links():
            keys, root = list(held), None if at[1] is None else at[1] % (1 << 64)
            got = walk([np.frombuffer(held[k][1], dtype=np.uint64) for k in keys], [held[k][0] for k in keys], order, root) if len(keys) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in got], pa.int64()), pa.array([keys[j] for _, j in got], pa.int64())], ["a", "b"])

        for batch in batches:
            for branch, root, key, label, s in zip(*(batch.column(c).to_pylist() for c in ("branch", "root", "key", "label", "s"))):
                if held and at[0] != branch:
                    yield links()
                at = branch, root
                held[key] = label, s
        if held:
            yield links()

    with small_batches(spark, 64):
        rows = found.join(F.broadcast(branches) if small else branches, "key").select("branch", "root", "key", "label", "s")
        links = materialize(rows.repartition("branch").sortWithinPartitions("branch").mapInArrow(trimmed(run), "a bigint, b bigint"), "links")
    free(branches, wanted)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    docs = keyed_text(docs, id_col, text_col)
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession, 512):
        return joined(docs)


def joined(docs: DataFrame) -> DataFrame:
    table = sets_of(docs)
    hot = hot_shingles(table)
    entries = prefixes(docs, hot, hot_classes(table)).withColumn("salt", F.when(F.col("hot"), F.pmod("key", F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    part = Window.partitionBy("h", "salt")
    # Only shingles that several classes share go on; a frequent one's parts meet again by h.
    met = entries.select("*", F.lag("key").over(part.orderBy("key")).alias("before"), F.min(F.struct("key", "n", "at")).over(part).alias("rep"), F.max("key").over(part).alias("top"), F.count("*").over(part).alias("m"))
    met = met.where("(before is null or before <> key) and (hot or top > rep.key)")
    ok = (F.col("key") != F.col("rep.key")) & possible(F.col("n"), F.col("at"), F.col("rep.n"), F.col("rep.at"))
    met = materialize(met.select("h", "key", "n", "at", (F.col("hot") | (F.col("m") > BRANCH)).alias("hot"), F.when(ok, F.col("rep.key")).alias("rep")), "met")
    star = met.where("rep is not null").groupBy(F.col("key").alias("a")).agg(F.min("rep").alias("b"))
    links = linked(stars(near(star, table)), table, docs, hot)
    label = labels(links)
    links = links.union(linked(roots(met, label, table), table, docs, hot))
    free(met, label)
    return results(table, labels(links))


def near(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Written: the pairs (a, b, ...) whose bitmaps do not rule Jaccard 3/4 out."""
    one = table.where("kind = 0 and n > 0").select("key", "n", "bits").dropDuplicates(["key"])
    side = lambda x: one.select(F.col("key").alias(x), F.col("n").alias(f"__n{x}"), F.col("bits").alias(f"__s{x}"))
    names = pairs.columns

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("__na", "__sa", "__nb", "__sb")]
            kept = pa.array([7 * differences(sa, sb) <= na + nb for na, sa, nb, sb in zip(*cols)], pa.bool_())
            yield batch.select(names).filter(kept)

    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "__na", "__sa", "__nb", "__sb").mapInArrow(trimmed(run), pairs.schema), "near")


def stars(star: DataFrame) -> DataFrame:
    """Branches of classes a with the class b that they meet, BLOCK of them at most in expectation."""
    many = star.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = star.join(many, "b").withColumn("branch", F.xxhash64("b", F.pmod(F.xxhash64("a"), "blocks")))
    rows = rows.select("branch", F.col("a").alias("key")).union(rows.select("branch", "b")).distinct()
    return rows.select("branch", F.lit(None).cast("bigint").alias("root"), "key", F.col("key").alias("label"))


def labels(links: DataFrame) -> DataFrame:
    """Written: (key, component) of the classes with a link."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return materialize(components(ends, links).select(F.col("id").alias("key"), F.col("component_id").alias("component")), "components")


def roots(met: DataFrame, label: DataFrame, table: DataFrame) -> DataFrame:
    """Branches of the classes that meet under a root and may still link components."""
    parts = met.join(label, "key", "left").select("h", "key", "n", "at", "hot", F.coalesce("component", "key").alias("label"))
    often = parts.where("hot")
    several = often.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.min("key").alias("first")).where("lo < hi").select("h", "m", "first")
    often = materialize(often.join(several, "h").select("h", "key", "n", "at", "label", "m", "first"), "apart")
    pairs = paired(parts.where("not hot")).union(paired(often.where(F.col("m") <= BRANCH)))
    # A pair meets under the root where it has the fewest shingles before.
    pairs = near(pairs.groupBy("a", "la", "b", "lb").agg(F.min("r").alias("r")), table)
    side = lambda k, l: pairs.select(F.xxhash64("r.h").alias("branch"), F.lit(None).cast("bigint").alias("root"), F.col(k).alias("key"), F.col(l).alias("label"))
    few = side("a", "la").union(side("b", "lb")).distinct()
    large = often.where(F.col("m") > BRANCH)
    if large.isEmpty():
        return few
    clusters = components(large.select(F.col("key").alias("id")).distinct(), large.select(F.col("key").alias("a"), F.col("first").alias("b")).distinct())
    clusters = materialize(clusters.select(F.col("id").alias("key"), F.col("component_id").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    whole = clusters.join(sizes.where(F.col("m") <= CLUSTER), "cluster").join(large.select("key", "label").distinct(), "key")
    whole = blocks(whole.select(F.xxhash64("cluster", "m").alias("group"), "m", "key", "label")).withColumn("root", F.lit(None).cast("bigint"))
    by_root = large.join(clusters.join(sizes.where(F.col("m") > CLUSTER), "cluster").select("key"), "key", "left_semi")
    by_root = blocks(by_root.select(F.xxhash64("h").alias("group"), "m", "key", "label", F.col("h").alias("root")))
    return few.unionByName(likely(whole.unionByName(by_root), table))


def blocks(rows: DataFrame) -> DataFrame:
    """rows (group, m, key, ...) with the branch of each two blocks of a group of m, one row for each branch."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.withColumn("branch", F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")))


def likely(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(branch, root, key, label) of the members of branches that bitmaps leave a partner of another label."""
    bits = table.where("kind = 0 and n > 0").select("key", "n", "bits").dropDuplicates(["key"])

    def run(batches):
        held: list[tuple] = []

        def kept():
            which = np.flatnonzero(with_partner([r[3] for r in held], np.array([r[4] for r in held]), [r[5] for r in held]))
            out = [held[i][:4] for i in which.tolist()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], ["branch", "root", "key", "label"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("branch", "root", "key", "label", "n", "bits"))):
                if held and held[-1][0] != row[0]:
                    yield kept()
                held.append(row)
        if held:
            yield kept()

    rows = rows.join(bits, "key").select("branch", "root", "key", "label", "n", "bits").repartition("branch").sortWithinPartitions("branch")
    return rows.mapInArrow(trimmed(run), "branch bigint, root bigint, key bigint, label bigint")


def with_partner(labels: list[int], n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which of the sets may be linked with one of another label, by sizes and bitmaps."""
    label, size = np.array(labels), np.array([len(b) for b in bits])
    out = np.zeros(len(n), dtype=bool)
    for width in np.unique(size).tolist():
        low = np.flatnonzero(size == width)
        a = np.frombuffer(b"".join(bits[i] for i in low.tolist()), dtype=np.uint64).reshape(len(low), -1)
        for other in (width, 2 * width):  # the sizes of partners differ by a third at most
            high = np.flatnonzero(size == other)
            if not len(high):
                continue
            b = np.frombuffer(b"".join(bits[i] for i in high.tolist()), dtype=np.uint8).reshape(len(high), -1)
            if other > width:
                wide = np.unpackbits(b, axis=1)
                b = np.packbits(wide[:, ::2] | wide[:, 1::2], axis=1)
            b = b.view(np.uint64)
            for i in range(len(low)):
                apart = np.bitwise_count(a[i] ^ b).sum(axis=1, dtype=np.int64)
                x = low[i]
                found = high[(label[high] != label[x]) & (7 * apart <= n[high] + n[x])]
                if len(found):
                    out[x] = out[found] = True
    return out


def paired(parts: DataFrame) -> DataFrame:
    """(a, la, b, lb, r) of the pairs under roots of BRANCH classes at most that may be linked and have different labels."""
    one = F.struct("key", "n", "at", "label")
    groups = parts.groupBy("h").agg(F.collect_list(one).alias("m")).where(F.size("m") > 1)

    def with_later(x, i):
        may = lambda y: (x["label"] != y["label"]) & possible(x["n"], x["at"], y["n"], y["at"])
        pair = lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.when(x["key"] < y["key"], x["label"]).otherwise(y["label"]).alias("la"), F.greatest(x["key"], y["key"]).alias("b"), F.when(x["key"] < y["key"], y["label"]).otherwise(x["label"]).alias("lb"), (x["at"] + y["at"]).alias("at"))
        return F.transform(F.filter(F.slice("m", i + 2, BRANCH), may), pair)

    pairs = groups.select("h", F.explode(F.flatten(F.transform("m", with_later))).alias("x"))
    return pairs.select("x.a", "x.la", "x.b", "x.lb", F.struct("x.at", "h").alias("r"))


def results(table: DataFrame, label: DataFrame) -> DataFrame:
    rows = table.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "key")
    firsts = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = firsts.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = firsts.select("key", "component").join(least, "component").select("key", "component_id")
    return materialize(rows.join(by_class, "key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "joined")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; rows that repeat a doc_id and text become one.

    Rows with a null doc_id are kept if one of them has no linked document with an id. Texts are shuffled only for ids that are repeated.
    """
    found = join(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count("*").alias("n"))
    found = materialize(found.where("n > 1 or not kept"), "dropped")
    again = found.where("kept")
    mark = fresh(docs, "dropped_id")

    def matching(ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias(mark))
        return docs.join(F.broadcast(ids) if found_few else ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col(mark)), how)

    found_few = found.count() <= BROADCAST_ROWS
    once = matching(found, "left_anti")
    return once if again.isEmpty() else once.unionByName(matching(again, "left_semi").dropDuplicates(["doc_id", "text"]))
