import re

import pytest

from ctxrank.functions import globs
from ctxrank.operators.scan import reach_regex


def hit(path, *patterns):
    return re.match(globs.paths_regex(patterns).replace(r"\z", r"\Z"), path) is not None


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("a/**", "a", True), ("a/**", "a/b/c.py", True), ("a/**", "ab/c.py", False), ("*.py", "x/y/z.py", True), ("x/*.py", "x/y/z.py", False), ("**/z.py", "z.py", True), ("src/**/*.py", "src/a/b/x.py", True), ("src/**/*.py", "src/x.py", True), ("f[0-9].t", "f5.t", True), ("f[!0-9].t", "f5.t", False), ("a[b", "a[b", True), ("?.c", "ab.c", False), ("/top.txt", "top.txt", True), ("a.b", "axb", False)],
)
def test_matches(pattern, path, want):
    assert hit(path, pattern) is want


@pytest.mark.parametrize(("folder", "pattern", "want"), [("target", "target/**", True), ("huge_sibling", "target/**", False), ("huge_sibling/deep", "*.py", True), ("src/a/deep", "src/**/*.py", True), ("other", "src/**/*.py", False), ("src", "src/a/x.py", True), ("src/b", "src/a/x.py", False), ("src/a/x.py", "src/a/x.py", False)])
def test_reachable(folder, pattern, want):
    assert globs.reachable(folder, pattern) is want
    assert (re.match(reach_regex([pattern]).replace(r"\z", r"\Z"), folder) is not None) is want


def test_roots():
    assert globs.literal_roots(["a/b/**", "a/b/c/*.py", "d/e.py"]) == ["a/b", "d"]
    assert globs.literal_roots(["a/**", "*.py"]) is None
    assert globs.norm_globs("a, b") == ["a", "b"] and globs.norm_globs(None) == ["**/*"]


def test_path_classes(spark):
    from pyspark.sql import functions as F

    source = ["app/models/user.rb", "src/Program.cs", "lib/thing.kt", "pkg/mod.swift", "pandas/_libs/tslibs/base.pyi", "build_tools/run.sh"]
    other = ["doc/whatsnew.rst", "README.md", "data/fixture.csv", "conf/settings.yaml", "web/index.html", "go.sum", "tests/data/sheet.xlsx", "vendor/lib/pkg.go", "static/app.min.js", "docs/guide.py"]
    df = spark.createDataFrame([(p,) for p in source + other], "path string").withColumn("s", globs.is_source(F.col("path")))
    assert {r.path for r in df.where("s").collect()} == set(source)
    df = spark.createDataFrame([("a/.env",), ("x/id_rsa",), ("b.pem",), (".ssh/k",), ("ok.py",), ("a.PNG",), (".pdf",)], "path string")
    got = {r.path: (r.a, r.b) for r in df.select("path", globs.is_sensitive(F.col("path")).alias("a"), globs.is_binary(F.col("path")).alias("b")).collect()}
    assert [p for p, (a, _) in got.items() if a] == ["a/.env", "x/id_rsa", "b.pem", ".ssh/k"]
    assert [p for p, (_, b) in got.items() if b] == ["a.PNG"]
