"""Logs and answers of runs that may be broken off and started again.

A write of a batch is one Spark job into a folder of its own: it is committed whole or
leaves nothing that a reader sees. What is there is read before anything is made, so
that a run that is started again makes only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parts of a log or store; no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_part(rows: DataFrame, path: str, **part: str | int) -> None:
    """Rows as one part of a log, in place of what the same part had before."""
    rows.write.mode("overwrite").parquet("/".join([path, *(f"{name}={value}" for name, value in part.items())]))


def log_run(result: DataFrame, path: str, run: str) -> None:
    """The stages that each question of a pipeline's result passed, and its route and refusal, as the log of a run. Logged again, it takes the place of its own log only."""
    write_part(result.select("qid", "question", "route_kind", "trace", "refused", "refusal_reason", F.size("evidence").alias("n_evidence")), path, run=run)


RUN = "qid long, question string, route_kind string, trace array<string>, refused boolean, refusal_reason string, n_evidence int, run string"


def answer_once(asked: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, schema: str, batches: int = 8) -> DataFrame:
    """Each row of asked (key, ...) with its answer, made at most once for a key, whatever was broken off before.

    answer takes rows of asked whose keys have no answer yet, one of each, and gives key
    and the columns of schema. It is called for one batch of keys (by hash) after the
    other; a batch is kept as soon as it is done. A null key has no answer.
    """
    spark = asked.sparkSession
    names = [x.strip().split()[0] for x in schema.split(",")]
    stored = f"key string, {schema}, batch int"
    known = read_parts(spark, path, stored)
    missing = asked.where("key is not null").join(known.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
    missing = missing.withColumn("batch_", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int"))
    # an earlier run may have left a part of the same batch: a new one goes beside it
    left = [r.batch_ for r in missing.select("batch_").distinct().orderBy("batch_").collect()]  # `batches` rows at most
    taken = {r.batch for r in known.select("batch").distinct().collect()} if left else set()
    free = max(taken, default=-1) + 1
    for i, b in enumerate(left):
        write_part(answer(missing.where(F.col("batch_") == b).drop("batch_")).select("key", *names), path, batch=free + i)
    done = read_parts(spark, path, stored).select("key", *names).dropDuplicates(["key"])
    return asked.join(done, "key", "left")
