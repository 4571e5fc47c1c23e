"""The given tables as property graphs, document collections and questions, in Spark and in SQL.

Films are parts, people are customers, and a customer who bought a part is linked with
it by a kind that follows from the return flag. The history graph has customers as
persons, suppliers and nations as organizations, and orders as events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators.shared import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def films(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select(F.concat(F.lit("movie:"), "p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.array("p_type").alias("genres"), F.col("p_retailprice").alias("popularity"), (F.col("p_size") <= 25).alias("ko"), (1970 + F.col("p_size")).alias("year"), (F.col("p_brand") == "Brand#1").alias("awarded"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.concat(F.lit("person:"), "c_custkey").alias("id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("popularity"))


def credits(spark: SparkSession, sf: str) -> DataFrame:
    """Who did what in which film: the adjacency that most queries begin with, made once in a session."""
    return stored(spark, lambda: _credits(spark, sf), "credits", sf)


def _credits(spark: SparkSession, sf: str) -> DataFrame:
    bought = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey").join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_returnflag", "l_linenumber"), "k")
    kind = F.when(F.col("l_returnflag") == "N", "ACTED_IN").when(F.col("l_returnflag") == "A", "DIRECTED").otherwise("WROTE")
    rows = bought.groupBy("o_custkey", "l_partkey", kind.alias("kind")).agg(F.min("l_linenumber").alias("ord"))
    return rows.select(F.concat(F.lit("person:"), "o_custkey").alias("src"), F.concat(F.lit("movie:"), "l_partkey").alias("dst"), "kind", "ord", F.struct("o_custkey", "l_partkey", "kind").alias("seq"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf).select("id").unionByName(people(spark, sf).select("id"))


#: CTEs that any of the SQL texts may begin with.
SQL = """
with films as (
  select 'movie:' || p_partkey as id, p_partkey as seq, p_name as title, p_type as genre, p_retailprice as popularity, p_size <= 25 as ko, 1970 + p_size as year, p_brand = 'Brand#1' as awarded from part),
people as (select 'person:' || c_custkey as id, c_custkey as seq, c_name as name, c_acctbal as popularity from customer),
credits as (
  select 'person:' || o_custkey as src, 'movie:' || l_partkey as dst, case l_returnflag when 'N' then 'ACTED_IN' when 'A' then 'DIRECTED' else 'WROTE' end as kind,
    min(l_linenumber) as ord, o_custkey as s, l_partkey as d
  from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_partkey, l_returnflag)"""


def history_nodes(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n, o = (read(spark, sf, t) for t in ("customer", "supplier", "nation", "orders"))
    none = F.lit(None).cast("string")
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Person").alias("type"), F.col("c_mktsegment").alias("era"))
    rows = rows.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Organization").alias("type"), none.alias("era")))
    rows = rows.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Organization").alias("type"), none.alias("era")))
    return rows.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("Order#"), "o_orderkey").alias("name"), F.lit("Event").alias("type"), F.col("o_orderpriority").alias("era")))


def history_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, kind, ord, seq, doc: each order, each order's supplier, each customer's nation."""
    c, o, line = (read(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    none = F.lit(None).cast("int")
    took = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("PARTICIPATED_IN").alias("kind"))
    hit = line.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("AFFECTED").alias("kind")).distinct()
    member = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("MEMBER_OF").alias("kind"))
    return took.unionByName(hit).unionByName(member).withColumn("ord", none).withColumn("seq", F.struct("kind", "src", "dst"))


HISTORY_SQL = """
with hnodes as (
  select 'c' || c_custkey as id, c_name as name, 'Person' as type, c_mktsegment as era from customer
  union all select 's' || s_suppkey, s_name, 'Organization', null from supplier
  union all select 'n' || n_nationkey, n_name, 'Organization', null from nation
  union all select 'o' || o_orderkey, 'Order#' || o_orderkey, 'Event', o_orderpriority from orders),
hedges as (
  select 'c' || o_custkey as src, 'o' || o_orderkey as dst, 'PARTICIPATED_IN' as kind from orders
  union all select distinct 'o' || l_orderkey, 's' || l_suppkey, 'AFFECTED' from lineitem
  union all select 'c' || c_custkey, 'n' || c_nationkey, 'MEMBER_OF' from customer),
hdegree as (select id, count(*) as degree from (select src as id from hedges union all select dst from hedges) group by id)"""


#: What questions are made of; one for each customer, its form by the key.
FORMS = ["{a}와 {b}가 함께 출연한 영화는?", "{a}가 나온 영화 중 황금종려상을 받은 작품은?", "{a}의 출연작과 {b}의 연출작 알려줘", "{a}와 {b}에 누가 나와?", "{a}와 비슷한 작품", "{a} 티켓 예매", "그중에 {b}도 있어?"]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """qid, question: of each customer and the next one by key."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    both = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next")), "c_custkey", "left")
    text = F.element_at(F.array(*map(F.lit, FORMS)), (F.pmod("c_custkey", F.lit(len(FORMS))) + 1).cast("int"))
    return both.select(F.col("c_custkey").alias("qid"), F.replace(F.replace(text, F.lit("{a}"), F.col("c_name")), F.lit("{b}"), F.coalesce("next", "c_name")).alias("question"))


QUESTIONS_SQL = f""",
questions as (
  select c.c_custkey as qid, replace(replace(list_extract({FORMS!r}, cast(c.c_custkey % {len(FORMS)} + 1 as int)), '{{a}}', c.c_name), '{{b}}', coalesce(n.c_name, c.c_name)) as question
  from customer c left join customer n on n.c_custkey = c.c_custkey + 1)"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """id, label, popularity, seq of people: names, and as an alias the name without its last character."""
    p = people(spark, sf)
    return p.select("id", F.explode(F.array("name", F.expr("left(name, length(name) - 1)"))).alias("label"), "popularity", "seq")
