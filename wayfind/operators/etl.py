"""Batch work around the graph: chunks, verification, resolution, merging, votes, gates, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions.text import key
from wayfind.operators.shared import checkpointed

#: Size of a chunk, and from where on a paragraph is split hard.
CHUNK, HARD = 6000, 9600
#: Allowed types of both ends of each kind, and the kinds' labels.
SIGNATURES = {
    "PARTICIPATED_IN": (["Person"], ["Event"]), "FOUNDED": (["Person"], ["Organization"]), "MEMBER_OF": (["Person"], ["Organization"]),
    "LED": (["Person"], ["Organization", "Event"]), "AFFECTED": (["Event"], ["Organization"]), "STUDIED_UNDER": (["Person"], ["Person"]),
}
LABELS = {"PARTICIPATED_IN": "참여", "FOUNDED": "설립", "MEMBER_OF": "소속", "LED": "이끔", "AFFECTED": "영향", "STUDIED_UNDER": "사사"}
#: Least mean degree, share of the largest component, bridges, and edges within each era.
GATE = (5.0, 0.8, 50, 50)
#: Honorifics that may follow a name.
HONORIFICS = r"\s*(대통령|국방위원장|주석|총리|국무총리|장관|의원|선생|박사|교수|목사|신부|스님|장군|제독|왕|황제|공)$"

#: Words of respect after a name, in the order in which they are tried.
RESPECT = ["대왕", "대", "왕", "임금", "선생", "장군", "황제"]
#: How an article gives a pen name.
PEN_NAMES = [r"호(?:\(號\))?는\s*([가-힣]{1,4})\s*[(（]", r"호는\s*([가-힣]{2,4})"]
#: Offices, which are no organizations, and names beyond the graph's history.
OFFICE = "(관찰사|통제사|절도사|판서$|참판$|참의$|참지$|영의정|좌의정|우의정|정승$|유수$|부윤$|목사$|부사$|현감$|현령$|군수$|총재$|총장$|위원장$|대통령$|국무총리$|총리$|장관$|차관$|사령관$|본부장$|의장$|부의장$|의원$|주석$|서리$|교수$|박사$|회장$|대사$|시장$|도지사$|검사$|판사$|대제학$|제학$|사부$|대장$|원수$|비서관$|비서실장$)"
FOREIGN = [
    "마오쩌둥", "장제스", "스탈린", "레닌", "루스벨트", "트루먼", "맥아더", "히로히토", "도요토미 히데요시", "도쿠가와 이에야스", "조지 워싱턴", "링컨", "토머스 제퍼슨",
    "처칠", "히틀러", "덩샤오핑", "저우언라이", "오부치 게이조", "고이즈미 준이치로", "미국", "일본", "중국", "소련", "러시아", "영국", "프랑스", "독일", "베트남", "타이완",
    "명나라", "청나라", "원나라", "송나라", "후금", "베트남 공화국", "문화 대혁명", "2·26 사건", "미국 독립 전쟁", "미국 내전", "십자군 전쟁", "아편 전쟁", "신해혁명", "메이지 유신",
]


def squeeze(s: Column) -> Column:
    """White space as single spaces."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def chunks(docs: DataFrame, size: int = CHUNK, hard: int = HARD) -> DataFrame:
    """id, n, chunk of docs (id, text): paragraphs joined while they fit `size`; what is open is cut each `size` characters while it is longer than `hard`.

    Sizes are in characters, the separator between paragraphs not counted when they are
    joined. A last chunk of nothing but white space is left out.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(p) > size)
        joined = F.when(full | (s["open"] == ""), p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        cuts = F.greatest(F.ceil((F.length(joined) - hard) / size), F.lit(0)).cast("int")
        pieces = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substring(joined, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        done = F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.struct(F.concat(done, pieces).alias("done"), F.substring(joined, cuts * size + 1, F.length(joined)).alias("open"))

    packed = F.aggregate(F.split("text", r"\n\n+"), empty, add, lambda s: F.when(s["open"].rlike(r"\S"), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return docs.where("text is not null").select("id", F.posexplode(packed).alias("n", "chunk"))


#: Hashes of quotes that are broadcast at most; beyond it the join is shuffled.
BROADCAST_QUOTES = 500_000


def verify_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (quote_id, id) of a quote (quote_id, text) that stands in a document (id, text), white space squeezed.

    Documents that have a quote's inner words (all but the first and last, which may be
    parts of words; six at most) one after the other are compared whole, so that a quote
    meets few documents. Only hashes that some quote has leave a document's row. A quote
    of one or two words is looked up by the substrings of words as long as it.
    """
    lead = 6
    words = lambda c: F.split(c, " ")
    asked = quotes.select("quote_id", squeeze(F.col("text")).alias("quote")).where("quote <> ''").withColumn("n", F.least(F.size(words("quote")) - 2, F.lit(lead)))
    long = asked.where("n >= 1").withColumn("inner", F.xxhash64(F.slice(words("quote"), F.lit(2), F.greatest(F.col("n"), F.lit(0)))))
    texts = docs.select("id", squeeze(F.col("text")).alias("body"))
    split = texts.select("id", words("body").alias("w"))
    sizes = long.select("n").distinct().agg(F.collect_list("n").alias("sizes"))  # one row, six numbers at most
    grams = split.crossJoin(F.broadcast(sizes)).select("id", F.explode(F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.size("w")), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))))).alias("inner"))
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_QUOTES + 1).count() <= BROADCAST_QUOTES else df
    met = grams.join(few(long.select("inner").distinct()), "inner", "left_semi").distinct().join(long, "inner").select("id", "quote_id", "quote").distinct()
    short = asked.where("n < 1").withColumn("longest", F.array_max(F.transform(words("quote"), lambda w: F.struct(F.length(w).alias("size"), w.alias("w")))))
    keyed = short.select("quote_id", "quote", F.col("longest.w").alias("part"))
    lengths = keyed.select(F.length("part").alias("k")).distinct().agg(F.collect_list("k").alias("lengths"))  # one row, a few numbers
    parts = F.flatten(F.transform(F.array_distinct("w"), lambda w: F.flatten(F.transform(F.filter("lengths", lambda k: k <= F.length(w)), lambda k: F.transform(F.sequence(F.lit(1), F.length(w) - k + 1), lambda i: F.substring(w, i, k))))))
    held = split.crossJoin(F.broadcast(lengths)).where(F.size("lengths") > 0).select("id", F.explode(F.array_distinct(parts)).alias("part"))
    some = held.join(few(keyed.select("part").distinct()), "part", "left_semi").join(keyed, "part").select("id", "quote_id", "quote")
    return met.unionByName(some).join(texts, "id").where(F.col("body").contains(F.col("quote"))).select("quote_id", "id")


def signature_errors(edges: DataFrame) -> DataFrame:
    """edges (src_type, kind, dst_type, ...) with error: missing field, kind, type, or null if allowed."""
    ok = reduce(Column.__or__, ((F.col("kind") == k) & F.col("src_type").isin(a) & F.col("dst_type").isin(b) for k, (a, b) in SIGNATURES.items()))
    missing = reduce(Column.__or__, (F.coalesce(F.col(c), F.lit("")) == "" for c in ("src", "dst", "kind", "src_type", "dst_type")))
    return edges.withColumn("error", F.when(missing, "missing").when(~F.col("kind").isin(*SIGNATURES), "kind").when(~ok, "type"))


def drop_reasons(edges: DataFrame, office: Column | None = None, foreign: Column | None = None, short: int = 2) -> DataFrame:
    """edges with drop_reason: the first of office, foreign, self, short; null if kept.

    Offices and foreign names are told by their names, unless other conditions are given.
    """
    a, b = F.col("src"), F.col("dst")
    office = a.rlike(OFFICE) | b.rlike(OFFICE) if office is None else office
    foreign = a.isin(*FOREIGN) | b.isin(*FOREIGN) if foreign is None else foreign
    return edges.withColumn("drop_reason", F.when(office, "office").when(foreign, "foreign").when(a == b, "self").when((F.length(a) < short) | (F.length(b) < short), "short"))


def merge_triples(edges: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each (src, kind, dst): quotes and docs without repeats, in the order of seq, and n_quotes, n_docs of them.

    Repeats go before anything is gathered, combined in each task. most: only so many of
    each are listed, so that a triple with a million quotes is as short a row as any.
    """
    key = ["src", "kind", "dst"]
    both = F.array(F.struct(F.lit("quote").alias("what"), F.col("quote").cast("string").alias("value")), F.struct(F.lit("doc").alias("what"), F.col("doc").cast("string").alias("value")))
    once = edges.select(*key, "seq", F.inline(both)).groupBy(*key, "what", "value").agg(F.min("seq").alias("seq"))
    n = [F.count(F.when(F.col("what") == w, 1)).alias(f"n_{w}s") for w in ("quote", "doc")]
    counts = None
    if most is not None:
        counts = once.groupBy(*key).agg(*n, F.min("seq").alias("seq"))
        once = once.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "what").orderBy("seq"))).where(F.col("nth") <= most)
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("seq", "value")))), lambda x: x["value"]).alias(f"{w}s") for w in ("quote", "doc")]
    if counts is not None:
        return counts.join(once.groupBy(*key).agg(*listed), key)
    return once.groupBy(*key).agg(*listed, *n, F.min("seq").alias("seq"))


def majority(votes: DataFrame, by: str, choice: str, *ties: Column) -> DataFrame:
    """by, choice: the most frequent choice of each; ties by the given orders, then the first seen."""
    counted = votes.groupBy(by, choice).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), *ties, "first")
    return counted.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(by, choice, "n")


def strip_title(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, HONORIFICS, ""))


def resolve(surfaces: DataFrame, canon: DataFrame, least: int = 3) -> DataFrame:
    """surface, resolved, how of surfaces (surface, n, seq): what each name stands for, the title after it left out.

    By the dictionary canon (key, title, seq; of one key the first), by the only title
    that holds it (from `least` characters on), by what stands before a word of respect,
    by the most frequent way of writing it (the shortest, then the first of equal ones),
    or itself. Containment is an equi-join on those substrings of the titles that are as
    long as some surface.
    """
    first = canon.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("nth = 1").select("key", "title")
    asked = surfaces.withColumn("clean", strip_title(F.col("surface"))).withColumn("key", key(F.col("clean")))
    lengths = asked.where(F.length("clean") >= least).select(F.length("key").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # one row, a few numbers
    titles = canon.select("title").distinct().withColumn("k", key(F.col("title"))).where("k <> ''").crossJoin(F.broadcast(lengths))
    parts = titles.select("title", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.length("k") - i + 1)), lambda n: F.substring(F.col("k"), i, n)))))).alias("key"))
    only = parts.groupBy("key").agg(F.countDistinct("title").alias("n"), F.min("title").alias("partial")).where("n = 1").drop("n")
    out = asked.join(first.withColumnRenamed("title", "exact"), "key", "left").join(only, "key", "left").withColumn("partial", F.when(F.length("clean") >= least, F.col("partial")))
    for i, suffix in enumerate(RESPECT):
        base = F.when(F.col("clean").endswith(suffix) & (F.length("clean") - len(suffix) >= 2), key(F.substring(F.col("clean"), F.lit(1), F.length("clean") - len(suffix))))
        out = out.withColumn("base", base).join(first.select(F.col("key").alias("base"), F.col("title").alias(f"respect{i}")), "base", "left").drop("base")
    known = F.coalesce("exact", "partial", *(f"respect{i}" for i in range(len(RESPECT))))
    out = out.withColumn("known", known)
    forms = out.where("known is null").groupBy("key", "clean").agg(F.sum("n").alias("n"), F.min("seq").alias("first"))
    usual = forms.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.length("clean"), "first"))).where("nth = 1").select("key", F.col("clean").alias("usual"))
    out = out.join(usual, "key", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("partial").isNotNull(), "partial").when(F.col("known").isNotNull(), "respect").when(F.col("usual") != F.col("clean"), "surface").otherwise("itself")
    return out.select("surface", F.coalesce("known", "usual", "clean").alias("resolved"), how.alias("how"))


def pen_name(body: Column) -> Column:
    """The pen name that the first 3,000 characters of an article give; null if none."""
    head = F.substring(body, 1, 3000)
    found = F.coalesce(*(F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in PEN_NAMES))
    return F.when(F.length(found) >= 2, found)


def name_variants(name: Column) -> Column:
    """How a name may be written: without a bracketed end, white space, or middle dots; two characters at least."""
    n = F.regexp_replace(name, r"\s*\(.+\)$", "")
    return F.filter(F.array_distinct(F.array(n, F.regexp_replace(n, r"\s", ""), F.replace(n, F.lit("·"), F.lit(".")), F.replace(n, F.lit("·"), F.lit("")))), lambda v: F.length(v) >= 2)


def component_step(labels: DataFrame, links: DataFrame) -> DataFrame:
    low = links.join(labels, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("low"))
    return labels.join(low, "id", "left").select("id", F.least("label", F.coalesce("low", "label")).alias("label"))


def components(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component: the smallest id that is reachable, by labels that spread and are looked up again at each step."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()
    links = checkpointed(links)
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")).distinct())
    for _ in range(most):
        spread = component_step(labels, links)
        jumped = spread.alias("x").join(spread.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"))
        following = checkpointed(jumped)
        changed = following.join(labels.withColumnRenamed("label", "before"), "id").where("label <> before").limit(1).count()
        labels = following
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components are not stable after {most} rounds")


def largest_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, largest: the share of all nodes that the largest component has."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("largest"))


def era_edges(edges: DataFrame) -> DataFrame:
    """era, n of edges (src_era, dst_era): an edge counts once for each different era of its ends."""
    eras = F.filter(F.array_distinct(F.array("src_era", "dst_era")), lambda e: e.isNotNull())
    return edges.select(F.explode(eras).alias("era")).groupBy("era").agg(F.count("*").alias("n"))


def era_crossers(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, per_era: int = 3) -> DataFrame:
    """id, era, eras, degree: nodes with neighbours (either way) of two eras at least; the first of each era, each shown once, at its first era by name."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    spans = both.join(nodes.where("era is not null").select(F.col("id").alias("other"), "era"), "other").select("id", "era").distinct()
    crossers = spans.groupBy("id").agg(F.count("*").alias("eras"), F.collect_list("era").alias("all")).where("eras >= 2").join(degrees, "id")
    shown = quota_selection(crossers.select("id", "eras", "degree", F.explode("all").alias("era")), "era", [F.desc("eras"), F.desc("degree"), F.col("id")], per_era)
    return shown.groupBy("id").agg(F.min("era").alias("era"), F.first("eras").alias("eras"), F.first("degree").alias("degree"))


def era_buckets(edges: DataFrame) -> DataFrame:
    """bucket, n of edges (src_era, dst_era): same, cross, half (one end without an era), none."""
    a, b = F.col("src_era"), F.col("dst_era")
    bucket = F.when(a.isNull() & b.isNull(), "none").when(a.isNull() | b.isNull(), "half").when(a == b, "same").otherwise("cross")
    return edges.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quota_selection(rows: DataFrame, per: str, order: list[Column], quota: int) -> DataFrame:
    """The first `quota` rows of each group, with pos from 1."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("pos") <= quota)


def gate(mean_degree: Column, largest: Column, bridges: Column, within: Column) -> Column:
    """Whether a corpus is dense enough; within: the least number of edges within an era."""
    a, b, c, d = GATE
    return (mean_degree >= a) & (largest >= b) & (bridges >= c) & (within >= d)


def stats(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """One row with the size of each table."""
    return reduce(DataFrame.crossJoin, (t.agg(F.count("*").alias(name)) for name, t in tables.items()))
