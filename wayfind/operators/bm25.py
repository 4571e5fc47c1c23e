"""Okapi BM25 over an inverted index held as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import tokenize
from wayfind.operators.shared import checkpointed

#: Parameters of the score, and how often a title's tokens count.
K1, B, TITLE_BOOST = 1.2, 0.75, 3


@dataclass
class Index:
    """postings (tok, id, tf, len, df) and one row of totals (n, avg_len)."""

    postings: DataFrame
    totals: DataFrame


#: Distinct tokens of questions that are broadcast at most; beyond it the join is shuffled.
BROADCAST_TOKENS = 500_000


def build_index(docs: DataFrame, boost: int = TITLE_BOOST, asked: DataFrame | None = None, keep: bool = False) -> Index:
    """Of docs (id, title, text). Titles count `boost` times, in lengths too.

    asked (qid, text): only the tokens of these questions are listed, and only they are
    grouped and shuffled; lengths and totals are those of all. keep: what was counted is
    stored, so that documents are cut into tokens once less.
    """
    tokens = F.concat(F.flatten(F.array_repeat(tokenize(F.coalesce("title", F.lit(""))), boost)), tokenize(F.coalesce("text", F.lit(""))))
    listed = docs.select("id", tokens.alias("toks"))
    totals = listed.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("toks")), F.lit(1.0)).alias("avg_len"))
    rows = listed.select("id", F.size("toks").alias("len"), F.explode("toks").alias("tok"))
    if asked is not None:
        wanted = asked.select(F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("tok")).distinct()
        few = wanted.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
        rows = rows.join(F.broadcast(wanted) if few else wanted, "tok", "left_semi")
    counts = rows.groupBy("id", "tok", "len").agg(F.count("*").alias("tf"))
    counts = checkpointed(counts) if keep else counts
    df = counts.groupBy("tok").agg(F.count("*").alias("df"))
    return Index(counts.join(df, "tok"), totals)


def frequencies(docs: DataFrame, boost: int = TITLE_BOOST) -> DataFrame:
    """tok, df, tf over all docs (id, title, text): one aggregation, combined before the shuffle."""
    tokens = F.concat(F.flatten(F.array_repeat(tokenize(F.coalesce("title", F.lit(""))), boost)), tokenize(F.coalesce("text", F.lit(""))))
    once = lambda toks, n: F.transform(toks, lambda t: F.struct(t.alias("tok"), F.lit(n).alias("first")))
    rows = docs.select(tokens.alias("toks")).select(F.inline(F.concat(once(F.col("toks"), 0), once(F.array_distinct("toks"), 1))))
    return rows.groupBy("tok").agg(F.sum("first").alias("df"), F.count_if(F.col("first") == 0).alias("tf"))


def _gained(met: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """by, score: what tokens asked for (tok, times) and met in documents (id, tf, len, df) add up to."""
    met = met.crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return met.groupBy(*by).agg(F.sum(F.col("times") * idf * gain).alias("score")).where("score > 0")


def asked_tokens(queries: DataFrame) -> DataFrame:
    """qid, tok, times of queries (qid, text): a token counts as often as it is asked."""
    return queries.select("qid", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("times"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """qid, id, score of every document that shares a token with a query (qid, text)."""
    return _gained(asked_tokens(queries).join(index.postings, "tok"), index.totals, "qid", "id")


def search(index: Index, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The k best documents of each query, with pos from 1; ties by id."""
    found = scores(index, queries).withColumn("score", F.round("score", digits))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


#: Documents of a token from which on it is searched once for all queries that have it.
FREQUENT = 1000


def search_many(index: Index, queries: DataFrame, k: int = 10, digits: int = 6, frequent: int = FREQUENT) -> DataFrame:
    """The same as `search`, of many queries that share their frequent tokens.

    A document without a query's rare tokens is among its best only if it is among the
    best by the frequent ones, as tokens only add to a score. So these are ranked once for
    each different set of frequent tokens, and documents with a rare one are scored in full.
    """
    postings = checkpointed(index.postings)
    often = postings.where(F.col("df") > frequent)
    df = postings.select("tok", "df").distinct()
    asked = checkpointed(asked_tokens(queries).join(df, "tok").drop("df").join(often.select("tok").distinct().withColumn("often", F.lit(True)), "tok", "left"))
    common = asked.where("often").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tok", "times"))).alias("set"))
    sets = common.select("set").distinct()
    by_set = _gained(sets.select("set", F.inline("set")).join(often, "tok"), index.totals, "set", "id").withColumn("score", F.round("score", digits))
    best = Window.partitionBy("set").orderBy(F.desc("score"), "id")
    by_set = by_set.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
    rare = asked.where("often is null").join(postings, "tok")
    also = rare.select("qid", "id").distinct().join(asked.where("often").select("qid", "tok", "times"), "qid").join(often, ["tok", "id"])
    columns = ["qid", "id", "times", "tf", "len", "df"]
    full = _gained(rare.select(*columns).unionByName(also.select(*columns)), index.totals, "qid", "id").withColumn("score", F.round("score", digits))
    found = full.unionByName(common.join(by_set, "set").select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
