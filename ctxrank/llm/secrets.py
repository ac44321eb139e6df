"""Secret scan with base patterns and a randomness test battery (operator 2; DataFrame functions only).

Base kinds, leftmost and non-overlapping each: assign, access, hex (PATTERNS). The method adds spans of kind
`random`: runs of at least LEAST code characters that mix letters and digits and lie in no base span. Each gets
an encoding by its characters (hex, base32, base62, base64 or base64url) and, within that encoding's alphabet, three tests of the hypothesis that its
symbols are drawn at random: chi-squared for uniformity (Wilson-Hilferty), runs around the alphabet's middle, and serial
correlation of neighbours. The least of the three p-values is combined by Sidak's rule, so that p is uniform for random runs.

A false discovery here is a run called a secret that is not random. Within a class of length, runs that are not random
gather near 0, and those with p over a half are taken for random. How p is spread for random runs of the class (evenly
but for the short ones' coarse counts) is read off NULL generated runs for each one found, of its length and alphabet. What lies over a limit beyond the share
that the random ones should have there is the number of false secrets. The limit of a class is the least one, from its
floor on, at which that excess is at most FDR of the runs over it, give or take SLACK standard errors of a count.
Runs that pass all tests by chance of their letters are not told apart.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows
stay as they are; an empty table gives no rows; other columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, materialize

#: kind, pattern, group that must reach a length, that length
PATTERNS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KINDS = ("assign", "access", "hex", "random")
LEAST = 20
#: [0-9a-f]+ filtered to 16+ characters equals this, as the runs are maximal; so for the candidates.
RUNS = {"hex": r"[0-9a-f]{16,}"}
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: (characters of the encoding, its alphabet in order)
ENCODINGS = (
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[A-Z0-9]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[a-z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
FDR = 0.05
SLACK = 1.0
NULL = 3
#: First length of each class, and the least p-value of a secret in it.
CLASSES = ((20, 0.05), (28, 0.03), (40, 0.02), (64, 0.01), (128, 0.005))
BINS = 200


def located(text: Column, pattern: str, keep) -> Column:
    """array<struct<start, end, m>> of the matches of pattern for which keep(match string, its groups) holds.

    What lies between the matches comes from split() with the same pattern; running lengths give positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], begin.cast("string"), F.lit(","))).alias("out"))

    starts = F.split(F.aggregate(parts, start, step)["out"], ",")
    spans = F.zip_with(found, starts, lambda m, s: F.struct(F.try_to_number(s, F.lit("999999999999")).cast("int").alias("start"), m.alias("m")))
    spans = F.filter(spans, lambda x: x["m"].isNotNull() & keep(x["m"]))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return F.when(F.size(found) == 0, none).otherwise(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"))))


def tail(z: Column) -> Column:
    """Two-sided normal tail (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def alphabet_of(body: Column) -> Column:
    return F.coalesce(*[F.when(F.regexp_like(body, F.lit(f"^{chars}$")), F.lit(letters)) for chars, letters in ENCODINGS])


def p_value(token: Column) -> Column:
    """The least p-value of the battery, combined by Sidak's rule."""
    body = F.rtrim(token, F.lit("="))
    alphabet = alphabet_of(body)
    plain = F.translate(body, "-_", "+/")
    text = F.when(alphabet.endswith("+/"), plain).otherwise(body)
    base = F.struct(alphabet.alias("a"), F.filter(F.split(text, ""), lambda c: c != "").alias("c"))

    held = F.transform(F.array(base), lambda x: F.struct(F.length(x["a"]).cast("double").alias("k"), F.size(x["c"]).cast("double").alias("n"), F.transform(x["c"], lambda c: F.call_function("instr", x["a"], c).cast("double")).alias("v")))
    held = F.transform(
        held,
        lambda x: F.struct(
            x["k"].alias("k"),
            x["n"].alias("n"),
            x["v"].alias("v"),
            F.aggregate(F.transform(F.array_distinct(x["v"]), lambda d: F.pow(F.size(F.filter(x["v"], lambda y: y == d)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, y: a + y).alias("squares"),
            (F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + y) / x["n"]).alias("mean"),
            F.size(F.filter(x["v"], lambda y: y * 2 > x["k"])).cast("double").alias("high"),
            F.zip_with(F.slice(x["v"], 1, F.greatest(x["n"].cast("int") - 1, F.lit(0))), F.slice(x["v"], 2, F.greatest(x["n"].cast("int") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"),
        ),
    )

    def tests(x):
        n, k, high = x["n"], x["k"], x["high"]
        low = n - high
        chi2 = k / n * x["squares"] - n
        df = k - 1
        # Exact variance of the statistic under uniformity in place of 2 df, as n may be small beside k.
        spread = F.sqrt(2 * df * (n - 1) / n)
        chi2 = df + (chi2 - df) * F.sqrt(2 * df) / spread
        z1 = (F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p1 = F.when(z1 > 0, tail(z1) / 2).otherwise(1 - tail(z1) / 2)
        runs = 1 + F.size(F.filter(x["pairs"], lambda y: (y["a"] * 2 > k) != (y["b"] * 2 > k))).cast("double")
        mean = 2 * high * low / n + 1
        var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        p2 = F.when(var <= 0, F.when(high * low == 0, F.pow(F.lit(0.5), n - 1)).otherwise(F.lit(1.0))).otherwise(tail((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))
        across = F.aggregate(x["pairs"], F.lit(0.0), lambda a, y: a + (y["a"] - x["mean"]) * (y["b"] - x["mean"]))
        within = F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + (y - x["mean"]) * (y - x["mean"]))
        p3 = F.when(within <= 0, F.lit(0.0)).otherwise(tail((across / F.greatest(within, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        return 1 - F.pow(1 - F.least(F.lit(1.0), p1, p2, p3), F.lit(3.0))

    return F.element_at(F.transform(held, tests), 1)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, (first, _) in enumerate(CLASSES):
        out = F.when(n >= first, F.lit(i)).otherwise(out)
    return out


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __base array<struct<start,kind,end>> and __more array<struct<start,end,class,bin,p,null>>."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = []
    for i, (kind, pattern, group, least) in enumerate(PATTERNS):
        keep = (lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n) if group else (lambda m, n=least: F.length(m) >= n)
        base.append(of_kind(located(text, RUNS.get(kind, pattern), keep), i))
    docs = docs.withColumn("__base", F.array_sort(F.concat(*base)))
    more = located(text, CANDIDATE, lambda m: F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")))
    more = F.filter(more, lambda x: ~F.exists(F.col("__base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    scored = F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), length_class(F.length(x["m"])).alias("class"), p_value(x["m"]).alias("p"), F.array(*[bin_of(p_value(random_like(x["m"], x["start"] * NULL + r))) for r in range(NULL)]).alias("null")))
    scored = F.transform(scored, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["class"].alias("class"), bin_of(x["p"]).alias("bin"), x["p"].alias("p"), x["null"].alias("null")))
    return docs.withColumn("__more", scored)


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) * (BINS / 10))).cast("int")


def random_like(token: Column, seed: Column) -> Column:
    """A run of the token's length and alphabet, its letters drawn by hashes."""
    body = F.rtrim(token, F.lit("="))
    held = F.array(F.struct(body.alias("b"), alphabet_of(body).alias("a")))
    letter = lambda x, i: F.substring(x["a"], (F.pmod(F.xxhash64(x["b"], seed, i), F.length(x["a"])) + 1).cast("int"), F.lit(1))
    return F.element_at(F.transform(held, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["b"])), lambda i: letter(x, i)), "")), 1)


def floors(annotated: DataFrame) -> list[float]:
    """The p-value that a secret must exceed, by class; from counts in BINS bins of its logarithm, at most BINS rows a class."""
    tally = lambda bins: annotated.select(F.explode("__more").alias("x")).select(F.col("x.class").alias("c"), F.explode(bins).alias("b")).groupBy("c", "b").agg(F.count("*").alias("n")).collect()
    seen, null = tally(F.array("x.bin")), tally("x.null")
    return [limit({r.b: r.n for r in seen if r.c == c}, {r.b: r.n for r in null if r.c == c}, floor) for c, (_, floor) in enumerate(CLASSES)]


def limit(by: dict[int, int], null: dict[int, int], floor: float) -> float:
    """The limit of a class, given its runs and the random ones by bin (bin b: p from edge(b + 1) to edge(b))."""
    edge = lambda b: 10.0 ** (-b * 10 / BINS)
    half = next(b for b in range(BINS) if edge(b) < 0.55)
    over = lambda counts, b: sum(n for x, n in counts.items() if x < b)
    if not by or not over(null, half):
        return floor
    random = over(by, half) / over(null, half)
    for b in range(half * 8, half, -1):
        excess = over(by, b) - random * over(null, b)
        if edge(b) >= floor and excess <= FDR * over(by, b) + SLACK * over(by, b) ** 0.5:
            return edge(b)
    return max(floor, edge(half))


def all_spans(least: list[float]) -> Column:
    """Base and random spans by start, then kind as listed."""
    limits = F.array(*[F.lit(x) for x in least])
    random = F.filter(F.col("__more"), lambda x: x["p"] > F.element_at(limits, x["class"] + 1))
    return F.array_sort(F.concat(F.col("__base"), of_kind(random, 3)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each document."""
    found = materialize(annotate(keyed_text(docs)).select("doc_id", "__base", "__more"), "secrets")
    count = lambda i: F.size(F.filter("__spans", lambda s: s["kind"] == i)).cast("bigint")
    found = found.withColumn("__spans", all_spans(floors(found)))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of overlapping spans in text replaced by mark, and n_chars (if there) to match.

    A null text stays null; columns of any names stay as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = materialize(annotate(docs.select(row, F.col("text").cast("string").alias("text"))), "annotated")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("__spans", all_spans(floors(found))).withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    length = F.when(F.size("__spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
