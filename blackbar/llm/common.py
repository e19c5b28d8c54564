"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pathlib
import posixpath
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a private folder only for local sessions that name none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="blackbar-llm-")
    return _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application.

    The registered queries do this, as a session may be started from any folder. Jobs that
    install the package on the cluster need it not.
    """
    app = spark.sparkContext.applicationId
    if _SHIPPED.get("app") == app:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="blackbar-zip-")) / "blackbar_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED["app"] = app


def store(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back."""
    spark = df.sparkSession
    path = posixpath.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over all cores if it comes in fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of undirected int64 edges: (node, smallest node of its component)."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root
        low = np.minimum(root[u], root[v])
        root = root.copy()
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local_forest(batches):
    import pyarrow as pa

    from blackbar.llm.common import forest

    for batch in batches:
        if batch.num_rows:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of undirected bigint edges (a, b): rows (node, component), smallest member.

    Only nodes that have an edge to another node are returned. Every task first reduces its
    edges to a spanning forest, then large-star and small-star steps alternate until nothing
    changes. Steps aggregate minima per node, so a hub is combined before the shuffle; each
    result is written to the shared folder, so lineage stays short.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = store(edges.mapInArrow(_local_forest, "a bigint, b bigint").distinct(), "links")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).toDF("a", "b")
        if large:
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    seen = None
    for _ in range(rounds):
        now = mark(pairs)
        if now == seen:
            break
        seen = now
        pairs = store(star(star(pairs, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.union(roots)
