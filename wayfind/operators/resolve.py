"""Names and titles in questions, as equi-joins on prefixes of what stands at a token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import BRACKETS, NOT_A_CHARACTER, main_title, norm, token_suffixes, whole_keys
from wayfind.operators.shared import checkpointed


def mentioned(questions: DataFrame, labels: DataFrame, whole_short: bool = True) -> DataFrame:
    """Questions (qid, question) with the labels (id, label, ...) that they mention.

    A label of three characters at least begins at a token: each prefix of each token
    suffix, as long as some label is, is joined with the labels. One of two characters
    must be a whole word (with a particle or not), or with whole_short false begin at a
    token too. White space and case don't count.
    """
    named = labels.withColumn("key", norm(F.col("label"))).where(F.length("key") >= 2)
    longer = named.where(F.length("key") > 2) if whole_short else named
    lengths = longer.select(F.length("key").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # one row, a few numbers
    suffix = questions.select("qid", F.explode(token_suffixes(F.col("question"))).alias("s")).crossJoin(F.broadcast(lengths))
    prefixes = suffix.select("qid", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("s")), lambda n: F.substring(F.col("s"), F.lit(1), n))).alias("key")).distinct()
    found = prefixes.join(longer, "key").drop("key")
    return found.unionByName(mentioned_whole(questions, named.where(F.length("key") == 2).drop("key"))) if whole_short else found


def mentioned_whole(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions with the labels that they say as a whole word, with a particle or not."""
    said = questions.select("qid", F.explode(whole_keys(F.col("question"))).alias("key"))
    return said.join(labels.withColumn("key", norm(F.col("label"))), "key").drop("key")


def people_in(questions: DataFrame, people: DataFrame) -> DataFrame:
    """qid, id, label, popularity, seq, rank: people (id, name, aliases, popularity, seq) whom a question names; common words are no names."""
    labels = people.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label"), "popularity", "seq")
    return longest_hits(mentioned(questions, first_alike(labels.where((F.length("label") >= 2) & ~F.col("label").isin(*NOT_A_CHARACTER)))))


def first_alike(labels: DataFrame) -> DataFrame:
    """Of the nodes of labels (id, label, popularity, seq) that have all labels in common the first one's: all that `longest_hits` keeps of them.

    A question has either all of them by the same label or none, and each but the first is
    contained in it. So namesakes are not joined with every question that has their name.
    """
    sets = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.first("popularity").alias("popularity"), F.first("seq").alias("seq"))
    w = Window.partitionBy("labels").orderBy(F.desc("popularity"), "seq")
    return sets.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("id", F.explode("labels").alias("label"), "popularity", "seq")


def bracketed_titles(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """Questions with the titles (id, label, ...) that stand in brackets or quotes: an equi-join on what is in them."""
    inside = F.concat(*(F.regexp_extract_all("question", F.lit(f"(?=[{a}]([^{a}{b}]*)[{b}])"), 1) for a, b in BRACKETS))
    return questions.select("qid", F.explode(F.array_distinct(inside)).alias("key")).join(titles.withColumn("key", F.trim("label")), "key").drop("key")


def titles_in(questions: DataFrame, films: DataFrame) -> DataFrame:
    """qid, id, label, popularity, seq, rank: films (id, title, popularity, seq) that a question names.

    By the title; of one character, in brackets only; else by what stands before its
    subtitle, as a whole word.
    """
    # of films of one title the first: what a question has of a film follows from its title
    w = Window.partitionBy("label").orderBy(F.desc("popularity"), "seq")
    named = films.select("id", F.col("title").alias("label"), "popularity", "seq").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    full = mentioned(questions, named.where(F.length("label") >= 2)).unionByName(bracketed_titles(questions, named.where(F.length("label") < 2)))
    head = named.withColumn("label", main_title(F.col("label"))).where("label is not null")
    return longest_hits(full.unionByName(mentioned_whole(questions, head)))


def longest_hits(hits: DataFrame) -> DataFrame:
    """Of hits (qid, id, label, popularity, seq): each node's longest label, without labels that an earlier one of the question contains.

    The order is the label's length, then popularity; rank is from 1.
    """
    hits = hits.withColumn("key", norm(F.col("label"))).withColumn("size", F.length("key")).repartition("qid")
    w = Window.partitionBy("qid", "id").orderBy(F.desc("size"), "label")
    best = hits.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    # of one label only the first is left, so that what a question's labels are compared with are as many as it has different ones
    first = best.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "key").orderBy(F.desc("popularity"), "seq"))).where("nth = 1").drop("nth")
    order = Window.partitionBy("qid").orderBy(F.desc("size"), F.desc("popularity"), "seq")
    ranked = first.withColumn("rank", F.row_number().over(order)).withColumn("earlier", F.collect_list("key").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = ranked.where(~F.exists("earlier", lambda l: l.contains(F.col("key"))))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).drop("size", "key", "earlier")


def people_intersection(people: DataFrame, edges: DataFrame, films: DataFrame, most: int = 3, top: int = 5) -> DataFrame:
    """Films of all of a question's first people (qid, id, rank; two at least), the most popular first: relational division."""
    first = people.where(F.col("rank") <= most).select("qid", F.col("id").alias("src")).withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where("n > 1")
    films_of = first.join(edges.select("src", "dst").distinct(), "src").groupBy("qid", F.col("dst").alias("id")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    found = films_of.where("k = n").join(films.select("id", "popularity", "seq"), "id")
    w = Window.partitionBy("qid").orderBy(F.desc("popularity"), "seq")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("qid", "id", "popularity", "pos")


def title_parts(titles: DataFrame, films: DataFrame, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(qid, part (from 1), key, first: a question's first titles (qid, id, rank) by normalised title, and the film named; id, key, seq of all films)."""
    keyed = films.select("id", norm(F.col("title")).alias("key"), "seq")
    named = titles.select("qid", "id", "rank").join(keyed.select("id", "key"), "id").withColumn("nth", F.row_number().over(Window.partitionBy("qid", "key").orderBy("rank"))).where("nth = 1")
    parts = named.withColumn("part", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("part") <= most)
    return parts.select("qid", "part", "key", F.col("id").alias("first")), keyed


def common_people(questions: DataFrame, titles: DataFrame, films: DataFrame, edges: DataFrame, people: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(people: qid, id, acted, pos; films: qid, part, id, found) of questions that name two titles at least.

    People who are in some film of each title; of each title the first film that one of
    them is in, else the first. Who acted in all of these comes first where the question
    asks for actors, last where it asks for directors; then the most popular.
    """
    parts, keyed = title_parts(titles, films)
    asked = parts.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where("n > 1")
    # people of a title once for all questions; a question's begin with those of its rarest title, so that a title of many films is looked up, not listed
    members = edges.select(F.col("dst").alias("id"), "src", "kind").join(keyed.join(asked.select("key").distinct(), "key", "left_semi"), "id")
    of_key = members.select("key", "src").distinct()
    sizes = of_key.groupBy("key").agg(F.count("*").alias("size"))
    asked = checkpointed(asked.join(sizes, "key", "left").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("size", F.lit(0)), "part"))).drop("size"))
    several = asked.where("nth = 1").select("qid", "n")
    begin = asked.where("nth = 1").join(of_key, "key").select("qid", "n", "src")
    again = begin.join(asked.where("nth > 1").select("qid", "key"), "qid").join(of_key, ["key", "src"], "left_semi")
    common = checkpointed(again.groupBy("qid", "n", "src").agg(F.count("*").alias("k")).where("k = n - 1").select("qid", "src"))
    met = common.join(asked, "qid").join(members.select("key", "src", "id", F.col("seq").alias("at")), ["key", "src"])
    met = met.groupBy("qid", "part").agg(F.min(F.struct((F.col("id") != F.col("first")).alias("other"), "at", "id")).getField("id").alias("met"))
    picked = asked.join(met, ["qid", "part"], "left").select("qid", "part", F.coalesce("met", "first").alias("id"), F.col("met").isNotNull().alias("found"))
    played = edges.where("kind = 'ACTED_IN'").select(F.col("dst").alias("id"), "src").distinct()
    acted = picked.join(common.select("qid").distinct(), "qid", "left_semi").join(played, "id").groupBy("qid", "src").agg(F.countDistinct("part").alias("in"))
    rows = common.join(several, "qid").join(acted, ["qid", "src"], "left").withColumn("acted", F.coalesce(F.col("in") == F.col("n"), F.lit(False)))
    rows = rows.join(people.select(F.col("id").alias("src"), "popularity", "seq"), "src").join(questions.select("qid", "question"), "qid")
    first = F.when(F.col("question").rlike("배우|출연|연기"), (~F.col("acted")).cast("int")).when(F.col("question").rlike("감독|연출"), F.col("acted").cast("int")).otherwise(0)
    w = Window.partitionBy("qid").orderBy(first, F.desc("popularity"), "seq")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("qid", F.col("src").alias("id"), "acted", "pos"), picked


def seed_bridges(seeds: DataFrame, edges: DataFrame, titles: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """qid, anchor, other, person, kind: how a question's other seeds (qid, pos, id) share a person with its anchor.

    The anchor is the first seed that is a title the question names (titles: qid, id),
    else the first seed. A person whom the question names (people: qid, id) comes first,
    by the other seed's credits; then who is first billed there.
    """
    rows = seeds
    rows = rows.join(titles.select("qid", "id").distinct().withColumn("named", F.lit(True)), ["qid", "id"], "left") if titles is not None else rows.withColumn("named", F.lit(None).cast("boolean"))
    w = Window.partitionBy("qid").orderBy(F.coalesce("named", F.lit(False)).desc(), "pos")
    rows = rows.withColumn("first", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    others = rows.where("id <> first").select("qid", F.col("first").alias("anchor"), F.col("id").alias("other")).distinct()
    cast = others.join(edges.select(F.col("dst").alias("other"), "src", "kind", "ord", "seq"), "other")
    met = cast.join(edges.select(F.col("dst").alias("anchor"), "src").distinct(), ["anchor", "src"])
    # a person's last credit in the film counts, at the place of the first
    one = met.groupBy("qid", "anchor", "other", "src").agg(F.max(F.struct("seq", "ord", "kind")).alias("last"), F.min("seq").alias("place"))
    if people is not None:
        one = one.join(people.select("qid", F.col("id").alias("src")).distinct().withColumn("asked", F.lit(True)), ["qid", "src"], "left")
    else:
        one = one.withColumn("asked", F.lit(False))
    asked = F.coalesce("asked", F.lit(False))
    order = Window.partitionBy("qid", "other").orderBy(asked.desc(), F.when(asked, 0).otherwise(F.coalesce("last.ord", F.lit(99))), "place")
    return one.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("qid", "anchor", "other", F.col("src").alias("person"), "last.kind")


def in_order(previous: DataFrame, films: DataFrame) -> DataFrame:
    """qid, pos, id, ... of a previous answer (qid, ids): its films in the given order; what isn't known is missing."""
    return previous.select("qid", F.posexplode("ids").alias("pos", "id")).join(films, "id")
