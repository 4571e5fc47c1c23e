"""Building graphs from raw records: projections, corpus bounds, growth, filters, votes, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles that make no relation, categories that name no topic or too broad a one.
JUNK = r"^(\d+년|\d+년대|\d+세기|\d+월\s*\d+일|\d+월$|.*\s목록$|목록:|틀:|분류:|위키프로젝트|.*\s일람$)"
MAINT, BROAD = r"(문서$|^CS1|틀$|^모든\s|웹아카이브|위키데이터|출처가 필요|정확성)", r"^(\d+년 (출생|사망)|\d+세기 .*사람|병사한 사람|암살당한 .*)$"


def project_films(raw: DataFrame, genre_names: dict[int, str]) -> DataFrame:
    """Raw records (id, title, original_title, release_date, genre_ids, ...) with defaults: title, else the original one, else empty; year of the date; names of genres."""
    names = F.create_map(*(F.lit(x) for pair in genre_names.items() for x in pair))
    genres = F.filter(F.transform("genre_ids", lambda g: names[g]), lambda g: g.isNotNull())
    year = F.when(F.length("release_date") >= 4, F.substring("release_date", 1, 4).try_cast("int"))
    return raw.withColumn("title", F.coalesce("title", "original_title", F.lit(""))).withColumn("year", year).withColumn("genres", genres)


def usable(raw: DataFrame, least_votes: int = 0) -> DataFrame:
    """Records with an id, not for adults, with an overview of more than 10 characters and so many votes."""
    return raw.where(F.col("id").isNotNull() & ~F.coalesce("adult", F.lit(False)) & (F.length("overview") > 10) & (F.coalesce("vote_count", F.lit(0)) >= least_votes))


def is_junk(title: Column) -> Column:
    return F.trim(title).rlike(JUNK)


def is_topical(category: Column) -> Column:
    return ~category.rlike(MAINT) & ~category.rlike(BROAD)


def bounded(edges: DataFrame, people: DataFrame, films: DataFrame) -> DataFrame:
    """Edges with both ends in the corpus, once each."""
    return edges.join(people.select(F.col("id").alias("src")), "src", "left_semi").join(films.select(F.col("id").alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst", "kind"])


def attach_awards(people: DataFrame, awards: DataFrame) -> DataFrame:
    """people (id, name, ...) with the awards (name, award, year) of their name; people of one name share them."""
    listed = awards.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("year", "award"))).alias("awards"))
    return people.join(listed, "name", "left").withColumn("awards", F.coalesce("awards", F.array().cast(listed.schema["awards"].dataType)))


def thin_out(films: DataFrame, people: DataFrame, edges: DataFrame, least_cast: int = 3) -> tuple[DataFrame, DataFrame]:
    """Films with enough who act in them, and the people who are still in one of these.

    Who goes has no film left, so that no other film loses anyone: one round is enough.
    """
    cast = edges.where("kind = 'ACTED_IN'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).where(F.col("n") >= least_cast)
    kept = films.join(cast, "id", "left_semi")
    there = edges.join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return kept, people.join(there, "id", "left_semi")


def grow_corpus(films: DataFrame, edges: DataFrame, least_cast: int = 3, least_films: int = 2, least_votes: int = 100, most: int = 6000) -> DataFrame:
    """id, added: films at home with enough cast, then films abroad with enough votes of people who are in several of those.

    films: id, ko, vote_count, overview, adult, seq. People are taken in the order of
    their first edge, their films in the order of edges, until there are `most`.
    """
    cast = edges.where("kind = 'ACTED_IN'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n"))
    home = films.where("ko").join(cast.where(F.col("n") >= least_cast), "id", "left_semi").select("id")
    known = edges.join(home.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.countDistinct("dst").alias("n"), F.min("seq").alias("first")).where(F.col("n") >= least_films)
    abroad = usable(films.where("not ko"), least_votes).select(F.col("id").alias("dst"))
    reached = edges.join(known, "src").join(abroad, "dst").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("first", "seq")).alias("at"))
    room = home.agg(F.greatest(F.lit(most) - F.count("*"), F.lit(0)).alias("room"))  # one row
    taken = reached.orderBy("at").limit(most).withColumn("nth", F.row_number().over(Window.orderBy("at"))).crossJoin(F.broadcast(room)).where("nth <= room")
    return home.withColumn("added", F.lit(False)).unionByName(taken.select("id", F.lit(True).alias("added")))


def ambiguous(votes: DataFrame, by: str, choice: str) -> DataFrame:
    """by, n: what has been given more than one choice."""
    return votes.groupBy(by).agg(F.countDistinct(choice).alias("n")).where("n > 1")


def era_of(links: DataFrame, eras: list[str]) -> DataFrame:
    """title, era, n of links (title, seed, era): the era that most seeds of a title have; ties by the order of eras."""
    order = F.array_position(F.array(*map(F.lit, eras)), F.col("era"))
    counted = links.groupBy("title", "era").agg(F.countDistinct("seed").alias("n"))
    return counted.withColumn("nth", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), order))).where("nth = 1").drop("nth")


def category_overlap(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """title, era, cats of candidates (title, era, category): how many topical categories the seeds of its era (era, category) have too; one at least."""
    wanted = seeds.where(is_topical(F.col("category"))).select("era", "category").distinct()
    return candidates.where(is_topical(F.col("category"))).join(wanted, ["era", "category"]).groupBy("title", "era").agg(F.countDistinct("category").alias("cats"))


def mention_graph(docs: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst of docs (title, body) and names (title, variant): bodies that hold another title's variant, not after a Hangul syllable.

    Each place of a body, for each length that some variant has, is joined with the
    variants.
    """
    lengths = names.select(F.length("variant").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # one row, a few numbers
    rows = docs.select(F.col("title").alias("src"), "body").crossJoin(F.broadcast(lengths)).where(F.length("body") > 0)
    at = F.filter(F.sequence(F.lit(1), F.length("body")), lambda i: (i == 1) | ~F.substring(F.col("body"), i - 1, F.lit(1)).rlike("[가-힣]"))
    held = F.flatten(F.transform(at, lambda i: F.transform(F.filter("lengths", lambda n: n <= F.length("body") - i + 1), lambda n: F.substring(F.col("body"), i, n))))
    said = rows.select("src", F.explode(F.array_distinct(held)).alias("variant"))
    return said.join(names.select(F.col("title").alias("dst"), "variant"), "variant").where("src <> dst").select("src", "dst").distinct()


def density(nodes: DataFrame, mentions: DataFrame, components: DataFrame) -> DataFrame:
    """One row: edges, mutual pairs, mean degree, share of the largest component, bridges (no seeds, next to two seeds at least), edges within and across eras, and the least number within one.

    nodes: title, era, is_seed; components: id, component.
    """
    both = mentions.unionByName(mentions.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    mutual = mentions.join(mentions.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg((F.count("*") / 2).cast("long").alias("mutual"))
    n = nodes.agg(F.count("*").alias("n"))
    mean = both.agg(F.count("*").alias("ends")).crossJoin(n).select((F.col("ends") / F.col("n")).alias("mean_degree"))
    largest = components.groupBy("component").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("largest"))
    seeds = nodes.where("is_seed").select(F.col("title").alias("dst"))
    bridges = both.join(seeds, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("k")).where("k >= 2").join(nodes.where("not is_seed").select(F.col("title").alias("src")), "src", "left_semi").agg(F.count("*").alias("bridges"))
    era = lambda c: nodes.select(F.col("title").alias(c), F.col("era").alias(f"{c}_era"))
    within = mentions.join(era("src"), "src").join(era("dst"), "dst").agg(F.count("*").alias("edges"), F.count_if(F.col("src_era") == F.col("dst_era")).alias("within"), F.count_if(F.col("src_era") != F.col("dst_era")).alias("across"))
    era_pairs = mentions.join(era("src"), "src").join(era("dst"), "dst").where(F.col("src_era") == F.col("dst_era")).groupBy(F.col("src_era").alias("era")).agg(F.count("*").alias("n"))
    least = nodes.select("era").distinct().join(era_pairs, "era", "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("least_within"))
    return within.crossJoin(least).crossJoin(mutual).crossJoin(mean).crossJoin(largest).crossJoin(bridges)  # one row each
