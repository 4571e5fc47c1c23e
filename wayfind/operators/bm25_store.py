"""A BM25 index on disk: postings by token, with documents added and removed in segments.

A segment holds the postings of what was added with it, dealt into bins of tokens and
sorted by them, and the ids that it takes out of earlier segments. A search reads the
bins of the tokens that are asked for, the removed ids and a row of totals for each
segment, never the documents.

The best documents are found in two steps (MaxScore). A query's rare tokens give a
score that its k-th best document reaches at least; documents that have only tokens
whose greatest possible contributions stay below it together need not be looked at. So
the long lists of common tokens are read only for documents that rare ones have found.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions.text import tokenize
from wayfind.operators.bm25 import K1, TITLE_BOOST, B
from wayfind.operators.shared import checkpointed

BINS = 64
#: Postings of a query's rarest tokens that the first step scores, about.
FIRST = 2_000
TABLES = {"postings": "tok string, id long, tf long, len int, segment int, bin int", "docs": "id long, len int, segment int", "removed": "id long, segment int", "totals": "n long, length long, segment int"}


def bin_of(tok):
    return F.pmod(F.xxhash64(tok), F.lit(BINS)).cast("int")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name])


def alive(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows (id, segment, ...) that no later segment has taken out."""
    last = removed.groupBy("id").agg(F.max("segment").alias("gone"))
    return rows.join(last, "id", "left").where("gone is null or segment >= gone").drop("gone")


def next_segment(spark: SparkSession, path: str) -> int:
    return (table(spark, path, "totals").agg(F.max("segment")).first()[0] or 0) + 1


def remove(spark: SparkSession, path: str, ids: DataFrame, segment: int | None = None) -> None:
    """Take documents (id) out of the index; ids that aren't there change nothing."""
    number = segment or next_segment(spark, path)
    there = alive(table(spark, path, "docs"), table(spark, path, "removed")).where(F.col("segment") < number).join(ids.select("id").distinct(), "id", "left_semi").select("id", "len")
    there = checkpointed(there)
    there.select("id").write.mode("overwrite").parquet(f"{path}/removed/segment={number}")
    if segment is None:
        there.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).cast("long").alias("length")).write.mode("overwrite").parquet(f"{path}/totals/segment={number}")


def add(docs: DataFrame, path: str, boost: int = TITLE_BOOST) -> None:
    """Add documents (id, title, text), in place of those with the same ids. Of several rows of one id any one counts."""
    spark = docs.sparkSession
    number = next_segment(spark, path)
    docs = docs.where("id is not null").dropDuplicates(["id"])
    before = alive(table(spark, path, "docs"), table(spark, path, "removed")).join(docs.select("id"), "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    remove(spark, path, docs, number)
    tokens = F.concat(F.flatten(F.array_repeat(tokenize(F.coalesce("title", F.lit(""))), boost)), tokenize(F.coalesce("text", F.lit(""))))
    listed = docs.select("id", tokens.alias("toks")).withColumn("len", F.size("toks"))
    counted = listed.select("id", "len", F.explode("toks").alias("tok")).groupBy("tok", "id", "len").agg(F.count("*").alias("tf")).withColumn("bin", bin_of("tok"))
    counted.repartition("bin").sortWithinPartitions("bin", "tok", "id").write.mode("overwrite").partitionBy("bin").parquet(f"{path}/postings/segment={number}")
    listed.select("id", "len").write.mode("overwrite").parquet(f"{path}/docs/segment={number}")
    # the totals are written last: a segment without them is written again by the next call
    new = spark.read.parquet(f"{path}/docs/segment={number}").agg((F.count("*") - before[0]).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) - before[1]).cast("long").alias("length"))
    new.write.mode("overwrite").parquet(f"{path}/totals/segment={number}")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, digits: int = 6, first: int = FIRST) -> DataFrame:
    """qid, id, score, pos: the k best documents of each query (qid, text), as a full scoring would give them; ties by id."""
    asked = checkpointed(queries.select("qid", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("times")))
    bins = [r.bin for r in asked.select(bin_of("tok").alias("bin")).distinct().collect()]  # BINS rows at most
    done = table(spark, path, "totals")
    n, length = done.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    average = length / n if n else 1.0
    postings = table(spark, path, "postings").where(F.col("bin").isin(bins)).join(done.select("segment"), "segment", "left_semi").join(asked.select("tok").distinct(), "tok", "left_semi")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average)))
    postings = alive(postings, table(spark, path, "removed").join(done.select("segment"), "segment", "left_semi")).select("tok", "id", gain.alias("gain"))
    frequency = checkpointed(postings.groupBy("tok").agg(F.count("*").alias("df"), F.max("gain").alias("top")))
    weight = F.col("times") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(frequency, "tok").withColumn("weight", weight).withColumn("most", F.col("weight") * F.col("top"))
    rare = Window.partitionBy("qid").orderBy("df", "tok")
    terms = checkpointed(terms.withColumn("before", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))).withColumn("early", F.coalesce("before", F.lit(0)) < first))

    def scores(of: DataFrame, within: DataFrame | None = None) -> DataFrame:
        met = of.select("qid", "tok", "weight").join(postings, "tok")
        if within is not None:
            met = met.join(within, ["qid", "id"], "left_semi")
        return met.groupBy("qid", "id").agg(F.sum(F.col("weight") * F.col("gain")).alias("score"))

    best = Window.partitionBy("qid").orderBy(F.desc("score"))
    reached = scores(terms.where("early")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    # tokens whose greatest contributions, from the smallest on, stay below what is reached
    light = Window.partitionBy("qid").orderBy("most", "tok")
    needed = terms.withColumn("sum", F.sum("most").over(light)).join(reached.select("qid", "least"), "qid", "left").where(F.col("least").isNull() | (F.col("sum") >= F.col("least") - 10.0**-digits))
    found = needed.select("qid", "tok").join(postings, "tok").select("qid", "id").distinct()
    ranked = scores(terms, found).withColumn("score", F.round("score", digits)).where("score > 0")
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("pos") <= k)
