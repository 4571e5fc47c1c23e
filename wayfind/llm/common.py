"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts are long, so that the default of 10,000 is too much memory.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches unless the session already sets something smaller; let Python workers import this package.

    The path helps where the workers see the driver's disk; a cluster gets the package
    as it gets any other (installed, or by --py-files).
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one (a test) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, dropping its lineage."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df  # else its shuffle files would outlive the release
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of plans that nobody holds any more.

    It does so when the driver's JVM collects them, which a driver with little to do may not
    do for hours; a loop of many shuffles would keep all their files until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, size: int | None, limit: int) -> DataFrame:
    """Hint a broadcast only where the measured size (rows or bytes) is within the limit; a shuffle join otherwise."""
    return F.broadcast(df) if (size or 0) <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b).

    Alternates large-star and small-star steps until the edges are stars, which a further
    round would leave as they are. Each step
    is a map-side combined minimum and an equi-join, so that a node with a large
    share of all links is dealt with by partial aggregation and skew splitting. Nodes
    without links do not occur. Null ends and self links are ignored.
    """
    ends = lambda x, y: F.inline(F.array(F.struct(F.col("u").alias(x), F.col("v").alias(y)), F.struct(F.col("v").alias(x), F.col("u").alias(y))))
    edges = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        both = edges.select(ends("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(
                F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
            )
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        # stars: no node has two edges down, or edges both up and down
        places = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).cast("long").alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).cast("long").alias("down"), F.lit(1).alias("up")))))
        node = places.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not node.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]:
            break
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
