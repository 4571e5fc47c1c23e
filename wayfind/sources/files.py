"""Graphs, documents and extraction logs from files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AWARD = "array<struct<award: string, year: int>>"
GRAPH = (
    f"movies array<struct<id: string, tmdbId: int, title: string, originalTitle: string, year: int, releaseDate: string, overview: string, genres: array<string>, countries: array<string>, originalLanguage: string, popularity: double, voteAverage: double, voteCount: int, posterPath: string, collection: int, awards: {AWARD}>>, "
    "people array<struct<id: string, tmdbId: int, name: string, originalName: string, department: string, popularity: double, aliases: array<string>, awards: array<struct<award: string, year: int, forTmdb: string, forTitle: string>>>>, "
    "edges array<struct<from: string, to: string, kind: string, origin: string, as: string, order: int>>, genreIndex map<string, array<string>>"
)
HISTORY = "nodes array<struct<id: string, type: string, era: string, aliases: array<string>, degree: int>>, edges array<struct<from: string, to: string, kind: string, quotes: array<string>, docs: array<string>>>"
EXTRACTION = "id string, doc string, era string, edges array<struct<from: string, fromType: string, to: string, toType: string, kind: string, quote: string>>"


def _rows(graph: DataFrame, name: str) -> DataFrame:
    """One part of a one-document graph as rows, with the place in the file as seq."""
    return graph.select(F.posexplode(name).alias("seq", "r")).select(F.col("seq").cast("long"), "r.*")


def _edges(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"from": "src", "to": "dst", "order": "ord", "as": "as_role"})


def read_movie_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """movies, people, edges, genre_index of a graph file (one JSON document)."""
    graph = spark.read.schema(GRAPH).json(path, multiLine=True)
    index = graph.select(F.explode("genreIndex").alias("genre", "ids")).select("genre", F.posexplode("ids").alias("pos", "id"))
    return {"movies": _rows(graph, "movies"), "people": _rows(graph, "people"), "edges": _edges(_rows(graph, "edges")), "genre_index": index}


def read_history_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    graph = spark.read.schema(HISTORY).json(path, multiLine=True)
    return {"nodes": _rows(graph, "nodes"), "edges": _edges(_rows(graph, "edges"))}


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """title, category, era, aliases, body, file of documents: `# title`, header lines, a blank line, the body; without a title, skipped."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    head = lambda name: F.regexp_extract("value", rf"(?m)^{name}: *(.*)$", 1)
    aliases = F.filter(F.split(head("별칭"), r"\s*,\s*"), lambda a: a != "")
    body = F.array_join(F.slice(F.split("value", "\n\n"), F.lit(2), F.lit(1 << 30)), "\n\n")
    return files.select(F.regexp_extract("value", r"(?m)^# (.+)$", 1).alias("title"), head("분류").alias("category"), head("시대").alias("era"), aliases.alias("aliases"), body.alias("body"), "file").where("title <> ''")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """src, src_type, dst, dst_type, kind, quote, doc, era, chunk of extraction lines; blank lines are skipped."""
    lines = spark.read.schema(EXTRACTION).json(path).where("id is not null")
    return lines.select("id", "doc", "era", F.posexplode("edges").alias("n", "e")).select(F.col("e.from").alias("src"), F.col("e.fromType").alias("src_type"), F.col("e.to").alias("dst"), F.col("e.toType").alias("dst_type"), F.col("e.kind").alias("kind"), F.col("e.quote").alias("quote"), "doc", "era", F.col("id").alias("chunk"), "n")


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work whose id isn't done yet: how an interrupted job goes on."""
    return work.join(done.select("id").distinct(), "id", "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines after those already there."""
    rows.write.mode("append").json(path)


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, and their sizes as one row of JSON."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    from wayfind.operators.etl import stats

    any_table = next(iter(tables.values()))
    stats(any_table.sparkSession, **tables).write.mode("overwrite").json(f"{path}/stats")


def cache_key(*parts: str):
    """Key of a cached answer: of the contents, not of their sizes."""
    return F.substring(F.sha1(F.concat_ws("\x00", *parts)), 1, 16)


def cached(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """What is asked (key, ...) with the answers known for its key; null where one has still to be made."""
    return asked.join(answers, "key", "left")


def start_log(spark: SparkSession, path: str, schema: str) -> None:
    """An empty log in place of an old one."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def extract(chunks: DataFrame, extractor, schema: str = "id string, edges array<struct<from: string, fromType: string, to: string, toType: string, kind: string, quote: string>>") -> DataFrame:
    """Edges of chunks (id, chunk) by a function of pandas batches; see replay for one that needs no model."""
    return chunks.select("id", "chunk").mapInPandas(extractor, schema)


def replay(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The edges that an earlier extraction gave for chunks (id); none where it gave none."""
    return chunks.select("id").join(known.select("id", "edges"), "id", "left")
