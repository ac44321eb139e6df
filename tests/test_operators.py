import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxrank.operators import chunks as ch
from ctxrank.operators import identity, rank, refs, scan
from ctxrank.plans import retrieve
from ctxrank.streaming import sessions


def test_windows():
    assert ch.windows(["x" * 1600 + "\n", "y\n"]) == [(0, 0, "x" * 1600 + "\n"), (1, 1, "y\n")]
    assert [w[:2] for w in ch.windows(["a" * 600 + "\n", "b" * 600 + "\n", "def f():\n", "c" * 10])] == [(0, 1), (2, 3)]
    assert [w[:2] for w in ch.windows(["a" * 600 + "\n", "b" * 600 + "\n", "\n", "c" * 10])] == [(0, 1), (2, 3)]
    assert ch.windows([]) == []


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=40))
def test_windows_keep_all(lines):
    assert "".join(w[2] for w in ch.windows(lines, 50)) == "".join(lines)


@settings(max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(0, 5))
def test_shards(lengths, overhead):
    plan = rank.shard_plan(lengths, overhead, 60)
    assert plan == sorted(plan) and len(plan) == len(lengths)
    for s in set(plan):
        assert sum(n for n, p in zip(lengths, plan) if p == s) + overhead <= 60


def test_shard_of_one_long_chunk():
    with pytest.raises(ValueError):
        rank.shard_plan([100], 0, 60)


def test_fill(spark):
    df = spark.createDataFrame([(1, r, i, c) for r, (i, c) in enumerate([(10, 5), (11, 9), (12, 2), (13, 3)])] + [(2, 0, 20, 99), (2, 1, 21, 1)], "g bigint, rank bigint, id bigint, cost bigint")
    got = {(r.g, r.place): r.id for r in rank.admitted(df, "g", 10).collect()}
    assert got == {(1, 0): 10, (1, 1): 12, (1, 2): 13, (2, 0): 20}


def test_fuse_of_one_query_keeps_order(spark):
    df = spark.createDataFrame([(0, c, r) for r, c in enumerate([7, 3, 5])], "query_id bigint, chunk_id bigint, rank bigint")
    assert [r.chunk_id for r in rank.fuse(df).orderBy("place").collect()] == [7, 3, 5]


def test_interleave(spark):
    df = spark.createDataFrame([(0, 0, 1, 9.0), (0, 0, 2, 8.0), (0, 0, 3, 7.0), (0, 1, 4, 1.0)], "query_id bigint, shard_id bigint, chunk_id bigint, score double")
    assert [r.chunk_id for r in rank.interleave(df).orderBy("rank").collect()] == [1, 4, 2, 3]


CASES = {
    "two callers": ([("lib.py", "def compute_total(x):\n    return x\n"), ("a.py", "import lib\nlib.compute_total(1)\n"), ("b.py", "import lib\ncompute_total(2)\n")], (2, 0, 0, "a.py:2,b.py:2")),
    "import only": ([("lib.py", "def compute_total(x):\n    return x\n"), ("a.py", "from lib import (\n    compute_total,\n)\n")], (0, 0, 0, "")),
    "comment only": ([("lib.py", "def compute_total(x):\n    return x\n"), ("a.py", "# compute_total\n")], (0, 0, 0, "")),
    "in tests": ([("lib.py", "def compute_total(x):\n    return x\n"), ("tests/test_lib.py", "compute_total(1)\n")], (0, 0, 1, "")),
    "typescript": ([("lib.ts", "export function compute_total(x) {}\n"), ("app.ts", "compute_total(1)\n")], (1, 1, 0, "app.ts:1")),
    "rust": ([("lib.rs", "pub fn compute_total(x: i32) {}\n"), ("main.rs", "fn go() {\n  compute_total(1);\n}\n")], (1, 1, 0, "main.rs:2")),
    "flood": ([("lib.py", "def compute_total(x):\n    return x\n")] + [(f"c{i:02}.py", "compute_total(1)\n") for i in range(17)], (17, 0, 0, ",".join(f"c{i:02}.py:1" for i in range(12)))),
}


@pytest.mark.parametrize("case", CASES)
def test_call_sites(spark, case):
    files, want = CASES[case]
    df = spark.createDataFrame(files, "path string, text string")
    got = refs.call_sites(refs.definitions(df).where("name = 'compute_total'"), df).collect()
    assert [(r.outside, r.same_file, r.in_tests, r.sites) for r in got] == [want]


DEFS = [("def f_one(", "f_one"), ("class Xabc:", "Xabc"), ("async def goes(", "goes"), ("export function compute(", "compute"), ("func Total(", "Total"), ("pub fn total_of(", "total_of"), ("type Abcd struct", "Abcd"), ("interface Abcd extends B", "Abcd"), ("impl Display for Foo", "Display"), ("trait Abcd where", "Abcd"), ("enum Abcd {", "Abcd"), ("cdef int compute_total(int x):", "compute_total"), ("cpdef float[] scale_all(x):", "scale_all"), ("type of the array", None), ("class objects returned by", None), ("public static void mainLoop(", None), ("void Solver::Solve(double *x)", None), ("cpdef double[:] scale(x):", None), ("def run(", None), ("x = 1", None)]


def test_definitions(spark):
    df = spark.createDataFrame([(str(i), line + "\n") for i, (line, _) in enumerate(DEFS)], "path string, text string")
    assert {(r.path, r.name) for r in refs.definitions(df).collect()} == {(str(i), n) for i, (_, n) in enumerate(DEFS) if n}


def test_identity(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5]), ([1], [1]), ([], [1]), ([2], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(identity.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 0]
    df = spark.createDataFrame([([3, 3, 3, 20, 1],)], "n array<bigint>")
    assert df.select(identity.block_bounds(F.col("n"), 5)).first()[0] == [0, 6, 11, 16, 21, 29]


def test_scope_and_retrieve(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "x = 1\n", "pkg/_priv.py": "def compute_total(a):\n    return a\n", "pkg/b.py": "print('other things')\n", "node_modules/m.js": "1\n", "pkg/empty.py": "", "pkg/a.png": "x", "pkg/.env": "S=1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    s = retrieve.scope(spark, str(tmp_path))
    assert sorted(r.path for r in s.files.collect()) == ["pkg/__init__.py", "pkg/_priv.py", "pkg/b.py"]
    assert {r.reason: r.n for r in s.coverage.collect()}["empty"] == 1
    best = retrieve.retrieve(spark, s.chunks, "where is compute_total", 500).collect()
    assert best[0].path == "pkg/_priv.py"
    assert retrieve.multi_retrieve(spark, s.chunks, ["compute_total", "other things"]).count() >= 2
    with pytest.raises(ValueError):
        retrieve.check_budget(True)


def test_gate_stream_equals_batch(spark, tmp_path):
    import pandas as pd

    spark.createDataFrame(pd.DataFrame({"event_id": range(40), "ts": pd.date_range("2024-01-01", periods=40), "user_id": [i % 3 for i in range(40)], "event_type": [["ask", "open", "ask"][i % 7 % 3] for i in range(40)]})).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    batch = {(r.event_id, r.allowed) for r in sessions.gate(events, "open", "ask").collect()}
    stream = sessions.gate_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "open", "ask")
    q = stream.writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event_id, r.allowed) for r in spark.table("gated").collect()} == batch


def test_enclosing_of_blank_and_top_level_starts():
    lines = ["def outer():", "    x = 1", "", "y = 2", "class C:", "    def m(self):", "", "", "        z = 3", "", "w = 4"]
    assert ch.enclosing(lines, 2) is None  # opens on a blank line before top-level code
    assert ch.enclosing(lines, 6) == "C.m"  # the first line with text counts
    assert ch.enclosing(["def f():", "x = 1"], 1) == "f"  # equally indented, just after a definition
    assert ch.enclosing(["def f():", "", ""], 1) is None


def test_folders_are_judged_by_what_is_in_them(spark):
    """An exclude that fits a folder's own name, but nothing below it, leaves the folder in."""
    df = spark.createDataFrame([("build1",), ("foo.map",), ("node_modules",), ("a/.git",)], "folder string")
    got = {r.folder: r.v for r in df.select("folder", scan.folder_verdict(["**/*"], ["build*", "**/*.map", "**/node_modules/**"]).alias("v")).collect()}
    assert got == {"build1": "kept", "foo.map": "kept", "node_modules": "dropped", "a/.git": "dropped"}


TEXTS = [(0, "alpha beta"), (1, "alpha beta"), (2, "beta gamma n"), (3, None), (4, ""), (5, "ALPHA-beta gamma, delta"), (6, "delta " * 3), (7, "xalpha beta gammax a")] + [(10 + i, f"alpha w{i} beta w{i % 7}") for i in range(60)]
ASKED = [(0, "alpha beta gamma"), (1, "delta"), (2, ""), (3, None), (4, "none of it"), (5, "w3 w4"), (6, "n/a")]


def brute_scores(digits=9):
    import math
    import re

    cut = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    df = {t: sum(t in cut(x) for _, x in TEXTS) for _, x in TEXTS for t in cut(x)}
    total = lambda found: round(sum(math.log(1 + len(TEXTS) / df[t]) for t in found), 9)
    return {(q, c): round(total(cut(a) & cut(x)) - total({"n", "a"} & cut(x)), digits) for q, a in ASKED for c, x in TEXTS if cut(a) & cut(x)}


def frames(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, text string"), spark.createDataFrame(TEXTS, "chunk_id bigint, text string").repartition(3)


@pytest.mark.parametrize("terms", [rank.BROADCAST_TERMS, 0])
def test_scores_and_best_places(spark, monkeypatch, terms):
    """All pairs, the best of each query and the places of chunks that hold a query, by counts in place and by joins."""
    monkeypatch.setattr(rank, "BROADCAST_TERMS", terms)
    want = brute_scores()
    order = {q: sorted((c for x, c in want if x == q), key=lambda c: (-want[q, c], c)) for q, _ in ASKED}
    assert {(r.query_id, r.chunk_id): round(r.score, 8) for r in rank.lexical_scores(*frames(spark)).collect()} == {k: round(x, 8) for k, x in want.items()}
    for k in (1, 3, 200):
        got = rank.top_k(rank.lexical_scores(*frames(spark), k=k), k).collect()
        assert {(r.query_id, r.rank): r.chunk_id for r in got} == {(q, i): c for q, x in order.items() for i, c in enumerate(x[:k])}
    held = {(q, c) for q, a in ASKED for c, x in TEXTS if a is not None and x is not None and a in x and (q, c) in want}
    assert dict(rank.best_places(*frames(spark)).collect()) == {q: min(order[q].index(c) + 1 for x, c in held if x == q) for q in {q for q, _ in held}}


def test_best_pairs_are_not_all_pairs(spark):
    """Tasks emit what may be among the best; Spark limits each task's rows before it deals them out."""
    queries = spark.createDataFrame([(0, "alpha beta")], "query_id bigint, text string")
    chunks = spark.range(5000).select(F.col("id").alias("chunk_id"), F.lit("alpha beta").alias("text")).repartition(2)
    scores = rank.lexical_scores(queries, chunks, k=5)
    assert scores.count() == 10
    assert [r.chunk_id for r in rank.top_k(scores, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert "WindowGroupLimit" in rank.top_k(rank.lexical_scores(queries, chunks), 5)._jdf.queryExecution().executedPlan().toString()


def test_place_beyond_max_k_counts(spark):
    queries = spark.createDataFrame([(0, "alpha beta gamma")], "query_id bigint, text string")
    texts = [(i, "alpha gamma beta") for i in range(300)] + [(300, "an alpha beta gamma")]
    assert [tuple(r) for r in rank.best_places(queries, spark.createDataFrame(texts, "chunk_id bigint, text string")).collect()] == [(0, 301)]


def test_round_as_sql(spark):
    import duckdb
    import numpy as np

    from ctxrank.operators import lexical

    values = [i / 100_000 + 73 for i in range(0, 2000, 5)] + [-2.5, -0.0, 0.0, 12.345678500000001]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert lexical.rounded(np.array(values), 4).tolist() == want
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(rank.rounded(F.col("x"), 4)).collect()
    assert [r[0] for r in got] == want
