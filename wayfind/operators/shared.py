"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one (a test) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: dict[tuple, tuple[DataFrame, str]] = {}
#: Bytes of a bucket, about; a table has MIN_BUCKETS at least.
BUCKET_BYTES, MIN_BUCKETS = 128 << 20, 8


def bucketed(df: DataFrame, *by: str, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """df as a table in the shared folder, in one file for each hash bucket of `by`, sorted by it.

    A join on `by` then moves the other side only. The number of buckets follows from the
    rows (counted, if not given).
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = max(MIN_BUCKETS, math.ceil((df.count() if rows is None else rows) * row_bytes / BUCKET_BYTES))
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def stored(spark: SparkSession, make: Callable[[], DataFrame], *key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """What make() returns in the shared folder, written once for a key in a session: what many queries begin with.

    by: bucketed by these columns. The tables that it was made from are taken not to
    change in a session; after a change, `forget`.
    """
    at = (spark.sparkContext.applicationId, *key, *by)
    if at not in _stored:
        df = make()
        if by:
            _stored[at] = (bucketed(df, *by), "")
        else:
            folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            _stored[at] = (spark.read.schema(df.schema).parquet(folder), folder)
    return _stored[at][0]


def forget() -> None:
    """Make what is stored anew the next time. Files stay until the shared folder is cleared, as results may still read them."""
    _stored.clear()
