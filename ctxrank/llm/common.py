"""What the operators of this subpackage share: the shared folder, written tables, shipped code, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file:///tmp/checkpoints/ctxrank-{os.getpid()}"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors.

    The files go with free(), at the latest when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ctxrank-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _file(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._ctxrank_path = path
    return out


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_ctxrank_path", None):
            target, system = _file(df.sparkSession, path)
            system.delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 32):
    """While plans run inside, workers get at most so many rows at a time: for rows that hold whole sets."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for workers that do not have it installed.

    Rows here hold whole texts: the session's batches for workers are lowered to BATCH_ROWS rows.
    """
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get(BATCHES)) <= BATCH_ROWS:
        spark.conf.set(BATCHES, BATCH_ROWS)
    if getattr(sc, "_ctxrank_shipped", None) == sc.applicationId:
        return
    target = f"{sc._temp_dir}/ctxrank_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._ctxrank_shipped = sc.applicationId


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def trimmed(run):
    """run, after which the worker gives the memory that it has freed back: workers stay for later stages."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns go."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(col, m: int):
    """crc32 of an id's decimal text, modulo m."""
    return F.crc32(F.col(col).cast("string")) % F.lit(m)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id reachable over undirected edges (a, b), for each id of nodes.

    Only ids with an edge take part. In each round every vertex is merged into the smallest one next to it (and
    on to that one's choice), and the graph shrinks to the merged vertices; each round is written to the shared folder.
    """
    graph = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a <> b")
    graph = materialize(graph.union(graph.select("v", "u")).distinct(), "edges")
    merged = None
    for _ in range(rounds):
        near = materialize(graph.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("near")), "near")
        step = near.join(near.select(F.col("u").alias("near"), F.col("near").alias("far")), "near").select("u", F.col("far").alias("to"))
        step = materialize(step, "labels")
        old = merged, graph
        if merged is None:
            merged = materialize(step.select(F.col("u").alias("id"), F.col("to").alias("label")), "merged")
        else:
            merged = materialize(merged.join(step.select(F.col("u").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "merged")
        graph = graph.join(step, "u").select(F.col("to").alias("u"), "v").join(step.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
        graph = materialize(graph.where("u <> v").distinct(), "edges")
        free(near, step, *[t for t in old if t is not None])
        if graph.isEmpty():
            free(graph)
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").join(merged, "id", "left").select("id", F.coalesce("label", "id").alias("component_id"))
