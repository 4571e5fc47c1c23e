"""Access to a property graph: nodes (id, seq, ...) and edges (src, dst, kind, ord, seq, ...).

seq is any orderable column that stands for the order of loading; ties end with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What comes first among a film's credits.
CREDIT_RANK = {"DIRECTED": -2, "WROTE": -1}
NO_ORDER = 99


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every node; an edge counts at both ends."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.select("id").join(ends.groupBy("id").count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti").select("id")


def hubs(degrees: DataFrame, n: int) -> DataFrame:
    """The n nodes of the highest degree."""
    return degrees.orderBy(F.desc("degree"), "id").limit(n)


def kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def neighbors(edges: DataFrame) -> DataFrame:
    """node, other, kind, dir (out before in), seq."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind", F.lit("out").alias("dir"), "seq")
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind", F.lit("in").alias("dir"), "seq"))


def credit_order(first: dict[str, int]) -> Column:
    rank = F.coalesce("ord", F.lit(NO_ORDER))
    for kind, r in first.items():
        rank = F.when(F.col("kind") == kind, F.lit(r)).otherwise(rank)
    return rank


def top_credits(edges: DataFrame, n: int, kinds: list[str] | None = None, first: dict[str, int] = CREDIT_RANK) -> DataFrame:
    """The first n credits of each film, with pos from 1."""
    rows = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    w = Window.partitionBy("dst").orderBy(credit_order(first), "seq")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def top_films(edges: DataFrame, films: DataFrame, n: int) -> DataFrame:
    """Each person's n most popular films."""
    found = edges.select(F.col("src").alias("person"), F.col("dst").alias("id")).distinct().join(films, "id")
    w = Window.partitionBy("person").orderBy(F.desc("popularity"), "seq")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("person", "id", "popularity", "pos")


def bridge_people(edges: DataFrame, films: DataFrame) -> DataFrame:
    """person, home, abroad: people with films at home and abroad, and how many of each."""
    found = edges.select(F.col("src").alias("person"), F.col("dst").alias("id")).distinct().join(films.select("id", "ko"), "id")
    return found.groupBy("person").agg(F.count_if("ko").alias("home"), F.count_if(~F.col("ko")).alias("abroad")).where("home > 0 and abroad > 0")


def genre_index(films: DataFrame, home: int = 30, abroad: int = 15) -> DataFrame:
    """genre, pos, id: of each genre the most popular films at home, then those abroad."""
    rows = films.select("id", "seq", "ko", "popularity", F.explode("genres").alias("genre"))
    w = Window.partitionBy("genre", "ko").orderBy(F.desc("popularity"), "seq")
    kept = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.when(F.col("ko"), home).otherwise(abroad))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("genre").orderBy(F.desc("ko"), "nth"))).select("genre", "pos", "id")


def coactor_pairs(edges: DataFrame, films: DataFrame, top: int = 600, least: int = 2, most: int = 12, cap: int = 4000) -> DataFrame:
    """a, b, person: pairs of the most popular films that share an actor with `least` to `most` of them, as they first come up, `cap` at most.

    People come in the order of their first edge, a person's films in that of the edges;
    the first person of a pair counts.
    """
    chosen = films.orderBy(F.desc("popularity"), "seq").limit(top).select(F.col("id").alias("dst"))
    acted = edges.where("kind = 'ACTED_IN'").groupBy("src", "dst").agg(F.min("seq").alias("seq"))
    order = acted.groupBy("src").agg(F.min("seq").alias("first"))
    listed = acted.join(F.broadcast(chosen), "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("seq", "dst"))).alias("v")).where(F.size("v").between(least, most)).join(order, "src")
    pairs = listed.select("src", "first", F.explode(F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.lit(most)), lambda y, j: F.struct(i.alias("i"), j.alias("j"), x["dst"].alias("a"), y["dst"].alias("b")))))).alias("p"))
    seen = pairs.groupBy("p.a", "p.b").agg(F.min(F.struct("first", "p.i", "p.j", "src")).alias("s"))
    return seen.orderBy("s.first", "s.i", "s.j").limit(cap).select("a", "b", F.col("s.src").alias("person"))


def describe_path(start: Column, hops: Column) -> Column:
    """`A ─via─▶ B ─via─▶ C` of hops (via, dst); empty without hops."""
    steps = F.transform(hops, lambda h: F.concat(F.lit(" ─"), h["via"], F.lit("─▶ "), h["dst"]))
    return F.when(F.size(hops) == 0, F.lit("")).otherwise(F.concat(start, F.array_join(steps, "")))


def describe_typed_path(start: Column, hops: Column, labels: dict[str, str]) -> Column:
    """`A ─label─▶ B ─label◀─ C` of hops (kind, dir, dst)."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    steps = F.transform(hops, lambda h: F.concat(F.lit(" ─"), F.coalesce(names[h["kind"]], h["kind"]), F.when(h["dir"] == "out", "─▶").otherwise("◀─"), F.lit(" "), h["dst"]))
    return F.when(F.size(hops) == 0, F.lit("")).otherwise(F.concat(start, F.array_join(steps, "")))
