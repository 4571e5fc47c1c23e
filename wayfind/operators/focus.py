"""What surrounds one node: its films, its relations, its neighbours and the quotes that bear them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def person_focus(edges: DataFrame, films: DataFrame, most: int = 14) -> DataFrame:
    """person, id, pos: each person's most popular films; the first is the centre."""
    from wayfind.operators.graph import top_films

    return top_films(edges, films, most).select("person", "id", "pos")


def film_focus(edges: DataFrame, films: DataFrame, centres: DataFrame, credits: int = 6, others: int = 3, most: int = 14) -> DataFrame:
    """centre, id, person, pos: other films of the first people of each centre (id), nothing twice, `most` nodes in all.

    A person gives the most popular films that no one before has given. Each person's
    first `most` films are enough to choose from, and the people come one by one in an
    exact fold.
    """
    from wayfind.operators.graph import top_credits, top_films

    used = edges.where(F.col("kind").isin("ACTED_IN", "DIRECTED"))
    first = top_credits(used, credits, first={"DIRECTED": -1}).join(centres.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("centre"), F.col("src").alias("person"), F.col("pos").alias("nth"))
    best = top_films(edges, films, credits * others + 2).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("films"))
    listed = first.join(best, "person").groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("nth", "person", "films"))).alias("people"))
    none = F.array().cast("array<struct<id string, person string>>")

    def step(s: Column, p: Column) -> Column:
        new = F.slice(F.filter(p["films"], lambda f: (f != F.col("centre")) & ~F.exists(s, lambda t: t["id"] == f)), 1, others)
        return F.slice(F.concat(s, F.transform(new, lambda f: F.struct(f.alias("id"), p["person"].alias("person")))), 1, most - 1)

    found = listed.select("centre", F.posexplode(F.aggregate("people", none, step)).alias("pos", "t"))
    return found.select("centre", F.col("t.id").alias("id"), F.col("t.person").alias("person"), (F.col("pos") + 1).alias("pos"))


def history_focus(edges: DataFrame, degrees: DataFrame, centres: DataFrame, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """(near: centre, id, pos; links: centre, a, b): the neighbours of the highest degree, and which of them are linked with each other.

    A node that is a neighbour several times takes as many of the `most` places.
    """
    from wayfind.operators.graph import neighbors

    n = neighbors(edges)
    rows = centres.select(F.col("id").alias("node")).join(n, "node").join(degrees.select(F.col("id").alias("other"), "degree"), "other", "left")
    order = Window.partitionBy("node").orderBy(F.desc(F.coalesce("degree", F.lit(0))), (F.col("dir") == "in"), "seq")
    first = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
    near = first.groupBy(F.col("node").alias("centre"), F.col("other").alias("id")).agg(F.min("pos").alias("pos")).where("id <> centre")
    a, b = near.select("centre", F.col("id").alias("src")), near.select("centre", F.col("id").alias("dst"))
    links = a.join(edges.select("src", "dst"), "src").join(b, ["centre", "dst"]).where("src <> dst").select("centre", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return near, links


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[·・.\s]|\(.+?\)", "")


def solidity(quote: Column, a: Column, b: Column) -> Column:
    """How many of the two names a quote holds."""
    return F.contains(_bare(quote), _bare(a)).cast("int") + F.contains(_bare(quote), _bare(b)).cast("int")


def card_quotes(edges: DataFrame, top: int = 2) -> DataFrame:
    """node, src, dst, kind, quote, doc, pos: of each node the edges with the best quotes (the one that holds most of both names), then with the most.

    edges: src, dst, kind, quotes, docs, seq.
    """
    from wayfind.operators.graph import neighbors

    # the first of the quotes that hold most of the names
    scored = F.transform("quotes", lambda q, i: F.struct((-solidity(q, F.col("src"), F.col("dst"))).alias("miss"), i.alias("i"), q.alias("q")))
    rows = edges.where(F.size("quotes") > 0).withColumn("best", F.array_min(scored)).select("src", "dst", "kind", "seq", F.col("best.q").alias("quote"), F.get("docs", F.lit(0)).alias("doc"), (F.size("quotes") - F.col("best.miss") * 10).alias("score"))
    n = neighbors(edges).select("node", "dir", F.col("seq"))
    met = n.join(rows, "seq")
    order = Window.partitionBy("node").orderBy(F.desc("score"), (F.col("dir") == "in"), "seq")
    return met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top).select("node", "src", "dst", "kind", "quote", "doc", "pos")
