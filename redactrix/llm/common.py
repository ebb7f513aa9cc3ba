"""Shared parts: tables, the shared folder, cutting lineage, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="redactrix-"))
        root = jsc.getCheckpointDir().get()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    ``drop`` removes those no longer read; what a returned DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def again(self, table: DataFrame) -> DataFrame:
        """The same written table as a relation of its own, for joining a table with itself."""
        out = self.spark.read.schema(table.schema).parquet(table._scratch_path)
        out._scratch_path = table._scratch_path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already when Python ends
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) for c in taken), default=0)
    return [next(n + "_" * k for k in range(longest + 1) if (n + "_" * k).lower() not in taken) for n in names]


def bucket_count(docs: DataFrame, size: int, column: str = "text") -> int:
    """Buckets of about ``size`` bytes of text each, at least as many as there are shuffle partitions: a scan of the lengths."""
    total = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


#: From this many edges down, what is left of a graph is finished in one task.
ONE_TASK_EDGES = 250_000


def _smallest_reachable(t: pa.Table) -> pa.Table:
    """(id, component) of the edges (a, b) of one table: roots hook to their smallest neighbour and labels are followed to the end, until no edge joins two roots."""
    a, b = (t.column(c).to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(ids[root], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (id, component): the smallest id reachable.

    Each round gives every node the first of itself and its neighbours in an order that is hashed anew, and joins
    nodes of one representative into one node. A node that comes last among its neighbours represents nobody, and
    on any graph a constant share of the nodes is expected to go, so rounds grow with the logarithm of the nodes
    and the graph shrinks from round to round; they go on until it has at most ``one_task`` edges. Rounds are
    written to the shared folder; nothing is collected but the count of edges. No edges: no rows.
    """
    ids = lambda t: t.select(F.col("a").alias("id")).union(scratch.again(t).select("b"))
    once = lambda t: t.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    given = scratch.write(edges.select("a", "b").distinct(), "edges")
    nodes = scratch.write(ids(given).distinct(), "nodes")
    left, levels = scratch.write(once(given), "edges"), []
    scratch.drop(given)
    while left.count() > one_task:
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(levels))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = left.select("a", "b").union(scratch.again(left).select(F.col("b").alias("a"), F.col("a").alias("b")))
        reps = both.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("id"), F.least(order("a"), "near")["id"].alias("rep"))
        levels.append(scratch.write(reps, "reps"))
        of = lambda c: scratch.again(levels[-1]).select(F.col("id").alias(c), F.col("rep").alias(f"rep_{c}"))
        joined = left.join(of("a"), "a").select("b", "rep_a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        smaller = scratch.write(once(joined), "edges")
        scratch.drop(left)
        left = smaller
    labels = scratch.write(left.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_smallest_reachable, "id long, component long"), "labels")
    scratch.drop(left)
    for reps in [*reversed(levels), nodes.withColumn("rep", F.col("id"))]:
        to = labels.select(F.col("id").alias("rep"), "component")
        wider = scratch.write(reps.join(to, "rep", "left").select("id", F.coalesce("component", "rep").alias("component")), "labels")
        scratch.drop(labels)
        labels = wider
    scratch.drop(nodes, *levels)
    if not levels:
        return labels
    # joined nodes bear the id of any of their own: take the smallest
    least = scratch.again(labels).groupBy("component").agg(F.min("id").alias("least"))
    return scratch.write(labels.join(least, "component").select("id", F.col("least").alias("component")), "labels")
