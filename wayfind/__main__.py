"""python -m wayfind history|movie GRAPH QUESTION...: what is found for questions, as JSON lines, without a language model."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wayfind import api


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="wayfind", description=__doc__)
    p.add_argument("graph", choices=["history", "movie"])
    p.add_argument("path")
    p.add_argument("questions", nargs="+")
    p.add_argument("--docs")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("wayfind").getOrCreate()
    out = api.ask_history(spark, a.path, a.questions, a.docs) if a.graph == "history" else api.ask_movies(spark, a.path, a.questions)
    lines = out.orderBy("qid").toJSON().collect()  # a row for each question of the command line
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
