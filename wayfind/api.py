"""The library's entry points over graph files: questions, fields, focus views and cards as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import domain, focus, graph, movies
from wayfind.sources import files


def history_domain(spark: SparkSession, path: str, docs: str | None = None, **options) -> domain.History:
    """The history domain of a graph file; docs: a path of Markdown documents, whose titles are node ids."""
    g = files.read_history_graph(spark, path)
    nodes = g["nodes"].withColumn("name", F.col("id"))
    bodies = files.read_markdown(spark, docs).select(F.col("title").alias("id"), "body") if docs else None
    return domain.History(nodes, g["edges"], bodies, **options)


def ask_history(spark: SparkSession, path: str, questions: list[str], docs: str | None = None, **options) -> DataFrame:
    """A row for each question: route, seeds, evidence, triples, sources, refusal and trace."""
    asked = spark.createDataFrame(list(enumerate(questions)), "qid long, question string")
    return domain.run(history_domain(spark, path, docs, **options), asked)


def history_field(spark: SparkSession, path: str, least: int = 2) -> dict[str, DataFrame]:
    """Nodes of that degree at least, and the edges among them."""
    g = files.read_history_graph(spark, path)
    nodes = g["nodes"].where(F.col("degree") >= least)
    keep = nodes.select("id")
    edges = g["edges"].join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return {"nodes": nodes, "edges": edges}


def history_card(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The best quotes of each of the nodes."""
    g = files.read_history_graph(spark, path)
    return focus.card_quotes(g["edges"]).where(F.col("node").isin(ids))


def history_focus(spark: SparkSession, path: str, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    g = files.read_history_graph(spark, path)
    return focus.history_focus(g["edges"], graph.degree(g["nodes"], g["edges"]), g["nodes"].where(F.col("id").isin(ids)))


def movie_domain(spark: SparkSession, path: str, **options) -> movies.Movies:
    """The domain of films of a graph file."""
    g = files.read_movie_graph(spark, path)
    m = g["movies"]
    films = m.select(
        "id", "seq", F.col("tmdbId").alias("tmdb_id"), "title", F.col("originalTitle").alias("original_title"), "year", F.col("releaseDate").alias("release_date"), "overview", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        (F.col("originalLanguage") == "ko").alias("ko"), "popularity", F.coalesce("voteAverage", F.lit(0.0)).alias("vote_average"), F.coalesce("voteCount", F.lit(0)).alias("vote_count"), F.coalesce("awards", F.array().cast(m.schema["awards"].dataType)).alias("awards"),
    )
    awards = F.transform("awards", lambda a: F.struct(a["award"].alias("award"), a["year"].alias("year"), a["forTmdb"].alias("for_tmdb"), a["forTitle"].alias("for_title")))
    none = F.array()
    people = g["people"].select("id", "seq", "name", F.coalesce("aliases", none.cast("array<string>")).alias("aliases"), "popularity", F.coalesce(awards, none.cast("array<struct<award string, year int, for_tmdb string, for_title string>>")).alias("awards"))
    return movies.Movies(films, people, g["edges"], **options)


def ask_movies(spark: SparkSession, path: str, questions: list[str], previous: tuple[str, list[str]] | None = None, **options) -> DataFrame:
    """A row for each question: route, seeds, evidence, steps, block of evidence, broken premise, refusal and trace.

    previous: the last question and the ids of its films, which the questions may point back at.
    """
    last, ids = previous or (None, [])
    asked = spark.createDataFrame([(i, q, ids, last) for i, q in enumerate(questions)], "qid long, question string, previous array<string>, previous_question string")
    return domain.run(movie_domain(spark, path, **options), asked)


def movie_focus(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    g = files.read_movie_graph(spark, path)
    return focus.film_focus(g["edges"], g["movies"], g["movies"].where(F.col("id").isin(ids)))
