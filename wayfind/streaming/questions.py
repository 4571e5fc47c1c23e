"""Questions as a stream: each micro-batch goes through a pipeline, answers are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfind.operators.route import route


def routed(questions: DataFrame) -> DataFrame:
    """A stream of questions with route and reason: a narrow map."""
    name, reason = route(F.col("question"))
    return questions.withColumn("route", name).withColumn("reason", reason)


def route_counts(questions: DataFrame, time: str = "asked", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Questions by route and window, with a watermark for late ones."""
    return routed(questions).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "route").agg(F.count("*").alias("n"))


def answer_stream(questions: DataFrame, pipeline: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each batch's answers as JSON lines; a batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        pipeline(df).write.mode("overwrite").json(f"{path}/batch={number}")

    writer = questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
