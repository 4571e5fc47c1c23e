"""The given tables as a fuller film graph: titles of every shape, genres, awards, roles, aliases, and questions about them.

What a part, a customer or a purchase doesn't have follows from its key; each table is
here in Spark and, as CTEs, in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators.route import GENRES
from wayfind.operators.shared import stored
from wayfind.plans.tables import SQL, credits, read

#: Syllables that names are made of, and how roles spell them.
SYLLABLES = ["가", "나", "다", "라", "마", "바", "사", "아", "자", "차", "카", "타", "파", "하"]
ROMAN = ["ga", "na", "da", "ra", "ma", "ba", "sa", "a", "ja", "cha", "ka", "ta", "pa", "ha"]
#: Titles of one character.
SHORT_TITLES = ["시", "콜", "잠", "섬", "업", "카", "별", "달"]
#: Awards of films and of people.
AWARDS = ["칸 영화제 황금종려상", "아카데미 작품상", "칸 영화제 여우주연상", "청룡영화상 감독상", "Gilde Film Price"]
#: What questions are made of; one for each customer, its form by the key.
FORMS = [
    "{a}와 {b}가 함께 출연한 영화는?", "《{t}》와 《{u}》에 모두 출연한 배우는?", "《{t}》에서 {c}를 연기한 배우가 출연한 다른 영화는?", "{a}가 나온 영화 알려줘", "{a}가 칸 여우주연상을 받은 영화는?",
    "최근 황금종려상 수상작은?", "《{t}》에 누가 나와?", "{g} 영화 추천해줘", "한국 {g} 중에 {w} 이야기", "{w} {v} 나오는 영화", "{c}라는 배역이 나오는 영화", "오늘 날씨 어때", "{t} 티켓 예매", "{x}의 비슷한 작품", "{m}의 감독은 누구",
]
N = len(SYLLABLES)


def pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def pick_sql(options: list[str], at: str) -> str:
    listed = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"
    return f"list_extract({listed}, cast(({at}) % {len(options)} + 1 as int))"


def name_of(k: Column, n: int) -> Column:
    return F.concat(*(pick(SYLLABLES, F.floor(k / N**i)) for i in range(n)))


def name_sql(k: str, n: int) -> str:
    return "(" + " || ".join(pick_sql(SYLLABLES, f"({k}) // {N**i}") for i in range(n)) + ")"


def title_of(k: Column, name: Column) -> Column:
    first = F.split_part(name, F.lit(" "), F.lit(1))
    return F.when(k % 5 == 0, F.concat(F.lit("n"), F.floor(k / 3), F.lit(": "), name)).when(k % 5 == 1, pick(SHORT_TITLES, k)).otherwise(F.concat_ws(" ", first, F.floor(k / 4)))


TITLE_SQL = f"case when {{k}} % 5 = 0 then 'n' || {{k}} // 3 || ': ' || {{n}} when {{k}} % 5 = 1 then {pick_sql(SHORT_TITLES, '{k}')} else split_part({{n}}, ' ', 1) || ' ' || {{k}} // 4 end"


def shows(spark: SparkSession, sf: str) -> DataFrame:
    """Films: id, seq, tmdb_id, title, original_title, year, release_date, overview, genres, ko, popularity, vote_average, vote_count, awards."""
    p = read(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    k, year = F.col("k"), (1970 + F.col("p_size")).cast("int")
    award = F.struct(pick(AWARDS, F.floor(k / 7)).alias("award"), year.alias("year"))
    second = F.struct(pick(AWARDS, F.floor(k / 11)).alias("award"), (year + 1).alias("year"))
    awards = F.when(k % 7 == 0, F.when(k % 11 == 0, F.array(award, second)).otherwise(F.array(award))).otherwise(F.array().cast("array<struct<award string, year int>>"))
    date = F.when(k % 3 != 0, F.format_string("%d-%02d-%02d", year, (F.pmod(k, F.lit(12)) + 1).cast("int"), (F.pmod(k, F.lit(28)) + 1).cast("int")))
    return p.select(
        F.concat(F.lit("movie:"), "k").alias("id"), k.alias("seq"), k.cast("int").alias("tmdb_id"), title_of(k, F.col("p_name")).alias("title"), F.col("p_brand").alias("original_title"), year.alias("year"), date.alias("release_date"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("w"), F.floor(k / 5))).alias("overview"), F.array(pick(GENRES, F.col("p_size").cast("long")), "p_type").alias("genres"), (F.col("p_size") <= 25).alias("ko"),
        F.col("p_retailprice").alias("popularity"), F.round(F.pmod(k, F.lit(97)) / 10, 1).alias("vote_average"), F.pmod(k * 31, F.lit(5000)).cast("int").alias("vote_count"), awards.alias("awards"),
    )


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """People: id, seq, name, aliases, popularity, awards (award, year, for_tmdb, for_title)."""
    c, n = read(spark, sf, "customer").withColumn("k", F.col("c_custkey")), read(spark, sf, "part").count()
    k = F.col("k")
    work = F.when(k % 4 != 3, F.pmod(k * 7, F.lit(n)))
    award = F.struct(pick(AWARDS, F.floor(k / 15)).alias("award"), (1990 + k % 30).cast("int").alias("year"), work.cast("string").alias("for_tmdb"), F.when(work.isNotNull(), F.concat(F.lit("T"), work)).alias("for_title"))
    other = F.struct(pick(AWARDS, F.floor(k / 15) + 2).alias("award"), (1991 + k % 30).cast("int").alias("year"), F.lit(None).cast("string").alias("for_tmdb"), F.lit(None).cast("string").alias("for_title"))
    awards = F.when(k % 3 == 1, F.array(other, award)).otherwise(F.array().cast("array<struct<award string, year int, for_tmdb string, for_title string>>"))
    return c.select(F.concat(F.lit("person:"), "k").alias("id"), k.alias("seq"), name_of(k, 3).alias("name"), F.when(k % 5 == 0, F.array(name_of(k, 2))).otherwise(F.array().cast("array<string>")).alias("aliases"), F.col("c_acctbal").alias("popularity"), awards.alias("awards"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Credits with the roles of those who acted."""
    c = credits(spark, sf)
    s, d = F.col("seq.o_custkey"), F.col("seq.l_partkey")
    role = F.concat_ws("-", F.initcap(pick(ROMAN, s + d)), pick(ROMAN, 3 * s + d))
    return c.withColumn("as_role", F.when(F.col("kind") == "ACTED_IN", role))


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """qid, question: one of each customer."""
    return stored(spark, lambda: _asks(spark, sf), "asks", sf)


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    c, p = read(spark, sf, "customer"), read(spark, sf, "part")
    n = p.count()
    k = F.col("k")
    rows = c.select(F.col("c_custkey").alias("k")).withColumn("pt", F.pmod(k * 7, F.lit(n))).withColumn("pu", F.pmod(k * 7 + 2, F.lit(n))).withColumn("pm", F.pmod(k * 7, F.lit(n)) - F.pmod(F.pmod(k * 7, F.lit(n)), F.lit(5)))
    named = p.select("p_partkey", title_of(F.col("p_partkey"), F.col("p_name")).alias("title"), "p_name")
    rows = rows.join(named.select(F.col("p_partkey").alias("pt"), F.col("title").alias("t"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")), "pt")
    rows = rows.join(named.select(F.col("p_partkey").alias("pu"), F.col("title").alias("u"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("v")), "pu")
    parts_ = {"a": name_of(k, 3), "b": name_of(k + 1, 3), "c": F.concat(pick(SYLLABLES, k + F.col("pt")), pick(SYLLABLES, 3 * k + F.col("pt"))), "g": pick(GENRES, k), "x": name_of(k, 2), "m": F.concat(F.lit("n"), F.floor(F.col("pm") / 3))}
    text = pick(FORMS, k)
    for name in "abctugwvxm":
        text = F.replace(text, F.lit("{" + name + "}"), parts_.get(name, F.col(name)))
    return rows.select(k.alias("qid"), text.alias("question"))


def _asks_sql() -> str:
    fill = {"a": name_sql("k", 3), "b": name_sql("k + 1", 3), "c": "(" + pick_sql(SYLLABLES, "k + pt") + " || " + pick_sql(SYLLABLES, "3 * k + pt") + ")", "g": pick_sql(GENRES, "k"), "x": name_sql("k", 2), "m": "('n' || (pt - pt % 5) // 3)", "t": "t", "u": "u", "w": "w", "v": "v"}
    text = pick_sql(FORMS, "k")
    for name in "abctugwvxm":
        text = f"replace({text}, '{{{name}}}', {fill[name]})"
    return text


CINEMA = (
    SQL
    + f""",
shows as (
  select 'movie:' || p_partkey as id, p_partkey as seq, cast(p_partkey as int) as tmdb_id, {TITLE_SQL.format(k="p_partkey", n="p_name")} as title, p_brand as original_title, 1970 + p_size as year,
    case when p_partkey % 3 <> 0 then printf('%d-%02d-%02d', 1970 + p_size, p_partkey % 12 + 1, p_partkey % 28 + 1) end as release_date,
    p_name || ' ' || lower(p_type) || ' w' || p_partkey // 5 as overview, [{pick_sql(GENRES, "p_size")}, p_type] as genres, p_size <= 25 as ko, p_retailprice as popularity, round(p_partkey % 97 / 10, 1) as vote_average, cast(p_partkey * 31 % 5000 as int) as vote_count,
    case when p_partkey % 77 = 0 then [{{'award': {pick_sql(AWARDS, "p_partkey // 7")}, 'year': 1970 + p_size}}, {{'award': {pick_sql(AWARDS, "p_partkey // 11")}, 'year': 1971 + p_size}}]
      when p_partkey % 7 = 0 then [{{'award': {pick_sql(AWARDS, "p_partkey // 7")}, 'year': 1970 + p_size}}] else [] end as awards
  from part),
stars as (
  select 'person:' || c_custkey as id, c_custkey as seq, {name_sql("c_custkey", 3)} as name, case when c_custkey % 5 = 0 then [{name_sql("c_custkey", 2)}] else [] end as aliases, c_acctbal as popularity,
    case when c_custkey % 3 = 1 then [
      {{'award': {pick_sql(AWARDS, "c_custkey // 15 + 2")}, 'year': 1991 + c_custkey % 30, 'for_tmdb': null, 'for_title': null}},
      {{'award': {pick_sql(AWARDS, "c_custkey // 15")}, 'year': 1990 + c_custkey % 30, 'for_tmdb': case when c_custkey % 4 <> 3 then cast(c_custkey * 7 % n as varchar) end, 'for_title': case when c_custkey % 4 <> 3 then 'T' || c_custkey * 7 % n end}}] else [] end as awards
  from customer, (select count(*) as n from part)),
parts as (
  select *, case when kind = 'ACTED_IN' then (s + d) % {N} end as ri, case when kind = 'ACTED_IN' then (3 * s + d) % {N} end as rj,
    case when kind = 'ACTED_IN' then upper(left({pick_sql(ROMAN, "s + d")}, 1)) || substr({pick_sql(ROMAN, "s + d")}, 2) || '-' || {pick_sql(ROMAN, "3 * s + d")} end as as_role
  from credits),
asks as (
  select k as qid, {_asks_sql()} as question
  from (select c_custkey as k, c_custkey * 7 % n as pt, (c_custkey * 7 + 2) % n as pu from customer, (select count(*) as n from part))
  join (select p_partkey as pt, {TITLE_SQL.format(k="p_partkey", n="p_name")} as t, split_part(p_name, ' ', 1) as w from part) using (pt)
  join (select p_partkey as pu, {TITLE_SQL.format(k="p_partkey", n="p_name")} as u, split_part(p_name, ' ', 2) as v from part) using (pu))"""
)
