"""What the corpus operators share: table access, the shared scratch folder, batch helpers and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/dossier"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where it is unset, a folder of this machine in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = FALLBACK_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stash_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stash/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all tables, archives and checkpoints that this application has written; call it when results are safe.

    Results are lazy and read these files, so no query can call it for itself; a job calls it last.
    """
    own = [stash_dir(spark), spark.sparkContext.getCheckpointDir()]
    for folder in own:
        if folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if named := spark.conf.get("spark.checkpoint.dir", None) or own[1]:
        spark.sparkContext.setCheckpointDir(named if spark.conf.get("spark.checkpoint.dir", None) else named.rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; for small, iterated tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several later steps read into the shared folder, compressed, and returns it reread.

    Results are lazy and may read it long after, so nothing here deletes it; ``sweep`` does, for the application.
    """
    spark = df.sparkSession
    path = f"{stash_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written table of ids up to which it may be broadcast (a long each, some 64 MB with the hash table).
BROADCAST_ROWS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcasting if its rows are few enough; else left to Spark's own joins."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that a Python worker holds the texts of a few hundred rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: links each larger neighbour to the smallest; small: links smaller neighbours to it.

    The minima are written before they join back, so both sides of the join are plain exchanges and adaptive
    execution can split the rows of a node that holds much of the graph.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b of type long) by alternating large and small stars.

    Returns (node, root), root being the smallest node reachable, for every node with an edge. Rows with nulls and
    loops are no edges. Each round halves path lengths, is checkpointed, and never holds the graph in one place.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())

    seen = state(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = cut(_star(_star(edges, large=True), large=False))
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
