"""Queries of graph building, density, focus views and quotes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators import build, etl, focus, graph
from wayfind.plans.cinema import CINEMA, parts, shows, stars
from wayfind.plans.queries import EXTRACTED_SQL, SQL, corpus, extracted, query
from wayfind.plans.tables import HISTORY_SQL, credits, films, history_edges, history_nodes, people, read

#: Chunks of a document: what is open grows by paragraphs, and is cut hard while it is far too long.
CHUNK_SQL = f"""with recursive ps as (select doc_id as id, regexp_split_to_array(text, '\\n\\n+') as p from documents where text is not null),
go(id, i, cur, done) as (
  select id, 0, '', cast([] as varchar[]) from ps
  union all
  select id, i + 1, substr(c, k * {etl.CHUNK} + 1), d || list_transform(range(k), lambda j: substr(c, j * {etl.CHUNK} + 1, {etl.CHUNK}))
  from (select id, i, c, d, cast(case when length(c) > {etl.HARD} then ceil((length(c) - {etl.HARD}) / {etl.CHUNK}) else 0 end as bigint) as k
    from (select g.id, g.i, case when shut then p[i + 1] else case when cur = '' then p[i + 1] else cur || chr(10) || chr(10) || p[i + 1] end end as c, case when shut then list_append(done, cur) else done end as d
      from (select *, cur <> '' and length(cur) + length(p[i + 1]) > {etl.CHUNK} as shut from go join ps using (id) where i < len(p)) g))),
fin as (select g.id, case when trim(cur, ' ' || chr(9) || chr(10) || chr(13)) <> '' then list_append(done, cur) else done end as cs from go g join ps using (id) where i = len(p))"""


@query(CHUNK_SQL + " select id, n, length(c) as size, sha256(c) as sha256 from (select id, unnest(cs) as c, unnest(range(len(cs))) as n from fin)")
def chunk_documents(spark, sf) -> DataFrame:
    return etl.chunks(corpus(spark, sf)).select("id", "n", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("sha256"))


ERAS_SQL = HISTORY_SQL + ", e2 as (select e.*, a.era as ea, b.era as eb from hedges e join hnodes a on a.id = e.src join hnodes b on b.id = e.dst)"


def with_eras(spark, sf) -> DataFrame:
    n = history_nodes(spark, sf)
    return history_edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("era").alias("src_era")), "src").join(n.select(F.col("id").alias("dst"), F.col("era").alias("dst_era")), "dst")


@query(ERAS_SQL + " select era, count(*) as n from (select unnest(list_distinct([ea, eb])) as era from e2) where era is not null group by era")
def era_edge_counts(spark, sf) -> DataFrame:
    """An edge counts once for each different era of its ends."""
    return etl.era_edges(with_eras(spark, sf))


@query(HISTORY_SQL + """, near as (select src as node, dst as other from hedges union all select dst, src from hedges),
spans as (select node, era, d.degree from (select distinct n.node, h.era from near n join hnodes h on h.id = n.other where h.era is not null) join hdegree d on d.id = node),
crossers as (select node, count(*) as eras, any_value(degree) as degree from spans group by node having count(*) >= 2),
shown as (select s.era, c.node, row_number() over (partition by s.era order by c.eras desc, c.degree desc, c.node) as pos from crossers c join spans s using (node))
select node as id, arg_min(era, era) as era, any_value(c.eras) as eras, any_value(c.degree) as degree from shown join crossers c using (node) where pos <= 3 group by node""")
def era_crossers_balanced(spark, sf) -> DataFrame:
    """Nodes whose neighbours, either way, span eras: three of each era, each shown once."""
    n, e = history_nodes(spark, sf), history_edges(spark, sf)
    return etl.era_crossers(n, e, graph.degree(n, e))


@query(HISTORY_SQL + """, quoted as (select *, 1 + length(dst) % 3 as quotes from hedges)
select cast(sum(quotes) as bigint) as quotes, count(*) filter (quotes > 1) as several, (select count(*) from hdegree where degree <= 1) as tail from quoted""")
def quote_totals(spark, sf) -> DataFrame:
    """Quotes, edges with several, nodes of one edge at most."""
    e = history_edges(spark, sf).withColumn("quotes", F.array_repeat(F.lit("q"), 1 + F.length("dst") % 3))
    tail = graph.degree(history_nodes(spark, sf), e).where("degree between 1 and 1").agg(F.count("*").alias("tail"))
    return e.agg(F.sum(F.size("quotes")).alias("quotes"), F.count_if(F.size("quotes") > 1).alias("several")).crossJoin(tail)


@query(HISTORY_SQL + """, near as (select src as node, dst as other, kind, 'out' as dir, src, dst from hedges union all select dst, src, kind, 'in', src, dst from hedges),
r as (select *, count(*) over (partition by node, dir, kind) as n, row_number() over (partition by node, dir, kind order by src, dst) as pos from near)
select node, dir, kind, other, n, pos, dense_rank() over (partition by node order by n desc, dir desc, kind) as place from r where pos <= 40""")
def neighbor_groups_listed(spark, sf) -> DataFrame:
    """A node's neighbours by direction and kind, the largest group first, 40 of each."""
    w = Window.partitionBy("node", "dir", "kind")
    n = graph.neighbors(history_edges(spark, sf)).withColumn("n", F.count("*").over(w)).withColumn("pos", F.row_number().over(w.orderBy("seq"))).where("pos <= 40")
    return n.withColumn("place", F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("dir"), "kind"))).select("node", "dir", "kind", "other", "n", "pos", "place")


NAMES_SQL = """with recursive t as (select p_name as title, min(p_type) as era, min(p_size) <= 3 as is_seed from part group by p_name),
names as (select distinct title, v as variant from (select title, unnest([title, replace(title, ' ', ''), split_part(title, ' ', 2)]) as v from t) where length(v) >= 2),
m as (select distinct a.title as src, n.title as dst from t a join names n on n.title <> a.title and regexp_matches(a.title || ' and ' || a.era, '(^|[^가-힣])' || n.variant))"""


def title_docs(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = read(spark, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_type").alias("era"), (F.min("p_size") <= 3).alias("is_seed"))
    variants = etl.name_variants(F.col("title"))
    names = t.select("title", F.explode(F.array_distinct(F.concat(variants, F.array(F.split_part("title", F.lit(" "), F.lit(2)))))).alias("variant"))
    return t.withColumn("body", F.concat_ws(" and ", "title", "era")), names.where(F.length("variant") >= 2)


@query(NAMES_SQL + " select src, dst from m")
def mention_graph(spark, sf) -> DataFrame:
    """Titles whose text mentions another title or one of its variants."""
    return build.mention_graph(*title_docs(spark, sf))


@query(NAMES_SQL + """, u as (select src, dst from m union select dst, src from m),
reach(id, root) as (select title, title from t union select u.dst, r.root from reach r join u on u.src = r.id where r.root < u.dst),
comp as (select id, min(root) as component from reach group by id),
br as (select src from u join t s on s.title = u.dst and s.is_seed group by src having count(*) >= 2)
select (select count(*) from m) as edges, (select count(*) from m a join m b on a.src = b.dst and a.dst = b.src) // 2 as mutual, round((select count(*) from u) / (select count(*) from t), 6) as mean_degree,
  round((select max(k) from (select count(*) as k from comp group by component)) / (select count(*) from t), 6) as largest, (select count(*) from br join t on t.title = br.src where not is_seed) as bridges,
  (select count(*) from m join t a on a.title = m.src join t b on b.title = m.dst where a.era = b.era) as within, (select count(*) from m join t a on a.title = m.src join t b on b.title = m.dst where a.era <> b.era) as across,
  (select min(n) from (select a.era, count(m.src) filter (b.era = a.era) as n from t a left join m on m.src = a.title left join t b on b.title = m.dst group by a.era)) as least_within,
  (select count(*) from u) / (select count(*) from t) >= 5 and (select max(k) from (select count(*) as k from comp group by component)) / (select count(*) from t) >= 0.8 and (select count(*) from br join t on t.title = br.src where not is_seed) >= 50
    and (select min(n) from (select a.era, count(m.src) filter (b.era = a.era) as n from t a left join m on m.src = a.title left join t b on b.title = m.dst group by a.era)) >= 50 as passes""")
def density_report(spark, sf) -> DataFrame:
    docs, names = title_docs(spark, sf)
    m = build.mention_graph(docs, names)
    parts_ = etl.components(docs.select(F.col("title").alias("id")), m)
    return build.density(docs, m, parts_).select("edges", "mutual", F.round("mean_degree", 6).alias("mean_degree"), F.round("largest", 6).alias("largest"), "bridges", "within", "across", "least_within", etl.gate(F.col("mean_degree"), F.col("largest"), F.col("bridges"), F.col("least_within")).alias("passes"))


@query(EXTRACTED_SQL + " select src, count(distinct kind) as n from x group by src having count(distinct kind) > 1")
def ambiguous_kinds(spark, sf) -> DataFrame:
    return build.ambiguous(extracted(spark, sf), "src", "kind")


ERAS = ["MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"]


@query(f"with l as (select distinct l_partkey as title, o_custkey as seed, c_mktsegment as era from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey), c as (select title, era, count(*) as n from l group by 1, 2) select title, era, n from (select *, row_number() over (partition by title order by n desc, list_position({ERAS!r}, era)) as nth from c) where nth = 1")
def era_by_links(spark, sf) -> DataFrame:
    """Each part's segment: that of most of those who bought it."""
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("title"))
    links = line.join(read(spark, sf, "orders"), "o_orderkey").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return build.era_of(links.select("title", F.col("o_custkey").alias("seed"), F.col("c_mktsegment").alias("era")), ERAS)


CATS_SQL = """with c as (select p_partkey as title, p_type as era, unnest([p_name, p_brand || ' 문서', '19' || p_size || '년 출생', p_brand]) as category, p_size % 5 = 0 as seed from part),
ok as (select * from c where not regexp_matches(category, '(문서$|^CS1|틀$|^모든\\s|웹아카이브|위키데이터|출처가 필요|정확성)') and not regexp_matches(category, '^(\\d+년 (출생|사망)|\\d+세기 .*사람|병사한 사람|암살당한 .*)$'))"""


@query(CATS_SQL + " select a.title, a.era, count(distinct a.category) as cats from ok a where not seed and exists (select 1 from ok s where s.seed and s.era = a.era and s.category = a.category) group by 1, 2")
def category_overlap(spark, sf) -> DataFrame:
    """Topical categories that a candidate shares with the seeds of its era."""
    p = read(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("title"), F.col("p_type").alias("era"), F.explode(F.array("p_name", F.concat("p_brand", F.lit(" 문서")), F.concat(F.lit("19"), "p_size", F.lit("년 출생")), "p_brand")).alias("category"), (F.col("p_size") % 5 == 0).alias("seed"))
    return build.category_overlap(rows.where("not seed"), rows.where("seed"))


@query(r"with t as (select doc_id, case doc_id % 5 when 0 then '19' || doc_id || '년' when 1 then source || ' 목록' when 2 then doc_id || '월 3일' when 3 then '틀:' || source else source || doc_id end as title from documents) select doc_id, regexp_matches(trim(title), '^(\d+년|\d+년대|\d+세기|\d+월\s*\d+일|\d+월$|.*\s목록$|목록:|틀:|분류:|위키프로젝트|.*\s일람$)') as junk from t")
def junk_titles(spark, sf) -> DataFrame:
    k, s = F.col("doc_id"), F.col("source")
    title = F.when(k % 5 == 0, F.concat(F.lit("19"), k, F.lit("년"))).when(k % 5 == 1, F.concat(s, F.lit(" 목록"))).when(k % 5 == 2, F.concat(k, F.lit("월 3일"))).when(k % 5 == 3, F.concat(F.lit("틀:"), s)).otherwise(F.concat(s, k))
    return read(spark, sf, "documents").select("doc_id", build.is_junk(title).alias("junk"))


RAW_SQL = CINEMA + """, raw as (select id, seq, tmdb_id, case when seq % 9 <> 0 then title end as title, case when seq % 18 <> 0 then original_title end as original_title, release_date, [seq % 4, 9] as genre_ids, case when seq % 6 = 0 then 'short' else overview end as overview, seq % 10 = 0 as adult, vote_count, ko from shows)"""
GENRE_NAMES = {0: "드라마", 1: "액션", 2: "코미디", 3: "범죄"}


def raw_films(spark, sf) -> DataFrame:
    k = F.col("seq")
    return shows(spark, sf).select("id", "seq", "tmdb_id", F.when(k % 9 != 0, F.col("title")).alias("title"), F.when(k % 18 != 0, F.col("original_title")).alias("original_title"), "release_date", F.array((k % 4).cast("int"), F.lit(9)).alias("genre_ids"), F.when(k % 6 == 0, F.lit("short")).otherwise(F.col("overview")).alias("overview"), (k % 10 == 0).alias("adult"), "vote_count", "ko")


@query(RAW_SQL + f" select id, coalesce(title, original_title, '') as title, cast(left(release_date, 4) as int) as year, list_extract({list(GENRE_NAMES.values())!r}, cast(genre_ids[1] + 1 as int)) as genre from raw")
def film_projection(spark, sf) -> DataFrame:
    return build.project_films(raw_films(spark, sf), GENRE_NAMES).select("id", "title", "year", F.array_join("genres", "/").alias("genre"))


@query(RAW_SQL + " select id from raw where not adult and length(overview) > 10 and vote_count >= 100")
def usable_films(spark, sf) -> DataFrame:
    return build.usable(raw_films(spark, sf), 100).select("id")


@query(SQL + " select src, dst, kind from credits where s % 10 <> 0 and d % 7 <> 0")
def corpus_bounded_edges(spark, sf) -> DataFrame:
    """Edges whose ends are both in the corpus: people by key, films by key."""
    return build.bounded(credits(spark, sf), people(spark, sf).where("seq % 10 <> 0"), films(spark, sf).where("seq % 7 <> 0")).select("src", "dst", "kind")


@query(CINEMA + """, given as (select name, a.award as award, a.year as year from (select name, unnest(awards) as a from stars))
select s.id, (select string_agg(g.year || g.award, '|' order by g.year, g.award) from given g where g.name = s.name) as awards from stars s""")
def award_attachment(spark, sf) -> DataFrame:
    """Awards by name: people of one name share them."""
    who = stars(spark, sf)
    given = who.select("name", F.explode("awards").alias("a")).select("name", "a.award", "a.year")
    out = build.attach_awards(who.select("id", "name"), given)
    return out.select("id", F.when(F.size("awards") > 0, F.array_join(F.transform("awards", lambda a: F.concat(a["year"], a["award"])), "|")).alias("awards"))


@query(RAW_SQL + """, rcast as (select dst from credits where kind = 'ACTED_IN' group by dst having count(distinct src) >= 3),
home as (select id from raw where ko and id in (select dst from rcast)),
known as (select src, min((s, d, kind)) as first from credits join home on home.id = dst group by src having count(distinct dst) >= 2),
abroad as (select c.dst as id, min((k.first, (c.s, c.d, c.kind))) as place from credits c join known k using (src) join raw r on r.id = c.dst where not r.ko and not r.adult and length(r.overview) > 10 and r.vote_count >= 100 group by c.dst)
select id, false as added from home union all select id, true from (select id, row_number() over (order by place) as nth from abroad) where nth <= greatest(300 - (select count(*) from home), 0)""")
def corpus_growth(spark, sf) -> DataFrame:
    """Films at home, then those abroad of their people, up to 300 in all."""
    return build.grow_corpus(raw_films(spark, sf), credits(spark, sf), most=300)


@query(SQL + """, late as (select * from credits where ord = 7), cast_ as (select dst from late where kind = 'ACTED_IN' group by dst having count(distinct src) >= 2)
select id, 'film' as what from films where id in (select dst from cast_) union all select id, 'person' from people where id in (select src from late where dst in (select dst from cast_))""")
def corpus_thinned(spark, sf) -> DataFrame:
    """Films with two who act in them, in the graph of seventh credits, and the people left in them."""
    kept, left = build.thin_out(films(spark, sf), people(spark, sf), credits(spark, sf).where("ord = 7"), 2)
    return kept.select("id", F.lit("film").alias("what")).unionByName(left.select("id", F.lit("person").alias("what")))


@query(SQL + " select person, id, pos from (select person, f.id, row_number() over (partition by person order by popularity desc, seq) as pos from (select distinct src as person, dst from credits) c join films f on f.id = c.dst) where pos <= 14")
def person_focus(spark, sf) -> DataFrame:
    return focus.person_focus(credits(spark, sf), films(spark, sf))


FOCUS_SQL = SQL.replace("with films", "with recursive films", 1) + """,
fcredits as (select * from (select dst as centre, src as person, row_number() over (partition by dst order by case kind when 'DIRECTED' then -1 else ord end, s, d, kind) as nth from credits where kind in ('ACTED_IN', 'DIRECTED')) where nth <= 6),
best as (select person, list(id order by popularity desc, seq) as fs from (select distinct src as person, dst as id from credits) join films using (id) group by person),
go(centre, nth, ids, via) as (
  select id, 0, [id], [''] from films
  union all
  select centre, nth, list_slice(ids || new, 1, 14), list_slice(via || list_transform(new, lambda x: person), 1, 14)
  from (select g.centre, c.nth, g.ids, g.via, c.person, list_slice(list_filter(b.fs, lambda f: not list_contains(g.ids, f)), 1, 3) as new from go g join fcredits c on c.centre = g.centre and c.nth = g.nth + 1 join best b on b.person = c.person))"""


@query(FOCUS_SQL + " select centre, ids[i + 1] as id, via[i + 1] as person, i as pos from (select centre, ids, via, unnest(range(1, len(ids))) as i from (select * from go qualify nth = max(nth) over (partition by centre)))")
def film_focus(spark, sf) -> DataFrame:
    """What each film leads to through its first people, nothing twice."""
    return focus.film_focus(credits(spark, sf), films(spark, sf), films(spark, sf).select("id"))


H_FOCUS_SQL = HISTORY_SQL + """, near as (select src as node, dst as other, kind, 0 as inward, src, dst from hedges union all select dst, src, kind, 1, src, dst from hedges),
fr as (select n.node as centre, n.other as id, row_number() over (partition by n.node order by d.degree desc, n.inward, n.kind, n.src, n.dst) as pos from near n join hdegree d on d.id = n.other where n.node in (select 'c' || c_custkey from customer)),
kept as (select centre, id, min(pos) as pos from fr where pos <= 16 and id <> centre group by centre, id)"""


@query(H_FOCUS_SQL + " select centre, id, pos from kept")
def history_focus_near(spark, sf) -> DataFrame:
    n, e = history_nodes(spark, sf), history_edges(spark, sf)
    return focus.history_focus(e, graph.degree(n, e), n.where("type = 'Person'").select("id"))[0].select("centre", "id", "pos")


@query(NAMES_SQL + """, deg as (select id, count(*) as degree from (select src as id from m union all select dst from m) group by id),
near as (select src as node, dst as other, 0 as inward, src, dst from m union all select dst, src, 1, src, dst from m),
fr as (select n.node as centre, n.other as id, row_number() over (partition by n.node order by d.degree desc, n.inward, n.src, n.dst) as pos from near n join deg d on d.id = n.other),
kept as (select distinct centre, id from fr where pos <= 16 and id <> centre)
select distinct a.centre, least(e.src, e.dst) as a, greatest(e.src, e.dst) as b from kept a join m e on e.src = a.id join kept b on b.centre = a.centre and b.id = e.dst where e.src <> e.dst""")
def history_focus_links(spark, sf) -> DataFrame:
    """Which of a title's neighbours mention each other."""
    docs, names = title_docs(spark, sf)
    m = build.mention_graph(docs, names).withColumn("kind", F.lit("MENTIONS")).withColumn("seq", F.struct("src", "dst"))
    titles = docs.select(F.col("title").alias("id"))
    return focus.history_focus(m, graph.degree(titles, m), titles)[1]


CARD_SQL = EXTRACTED_SQL + """, merged as (select src, kind, dst, case count(*) % 3 when 0 then ['nothing', dst || ' alone'] when 1 then ['nothing', src || ' met ' || dst] else [src || ' met ' || dst, src || ' and others', dst || ' alone', src || ' saw ' || dst] end as quotes, cast(min(k) as varchar) as doc, min((k, n, p, s)) as first from x group by src, kind, dst),
said as (select src, kind, dst, q, i, contains(q, src)::int + contains(q, dst)::int as holds from (select src, kind, dst, unnest(quotes) as q, unnest(range(len(quotes))) as i from merged)),
best as (select src, kind, dst, arg_min(q, (-holds, i)) as quote, max(holds) as holds from said group by 1, 2, 3),
pick as (select m.*, b.quote, len(m.quotes) + 10 * b.holds as score from merged m join best b using (src, kind, dst)),
near as (select src as node, 0 as inward, * from pick union all select dst, 1, * from pick)
select node, src, dst, kind, quote, doc, pos from (select *, row_number() over (partition by node order by score desc, inward, first) as pos from near) where pos <= 2"""


@query(CARD_SQL)
def card_quotes(spark, sf) -> DataFrame:
    """Of each node's edges the two with the best quotes: those that hold both names."""
    x = extracted(spark, sf).groupBy("src", "kind", "dst").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min(F.col("doc").cast("long")).cast("string").alias("doc"))
    met, alone, nothing = F.concat("src", F.lit(" met "), "dst"), F.concat("dst", F.lit(" alone")), F.lit("nothing")
    several = F.array(met, F.concat("src", F.lit(" and others")), alone, F.concat("src", F.lit(" saw "), "dst"))
    quotes = F.when(F.col("n") % 3 == 0, F.array(nothing, alone)).when(F.col("n") % 3 == 1, F.array(nothing, met)).otherwise(several)
    return focus.card_quotes(x.select("src", "kind", "dst", "seq", quotes.alias("quotes"), F.array("doc").alias("docs")))


@query(EXTRACTED_SQL + """, merged as (select src, kind, dst, count(distinct quote) as quotes, min((k, n, p, s)) as first from x group by src, kind, dst),
hop as (select 'c' || c_custkey as id, c_custkey % 3 as hop from customer union all select 'p' || p_partkey, p_partkey % 4 from part)
select src, kind, dst, row_number() over (partition by src order by least(a.hop, b.hop), quotes desc, first, dst, kind) as pos from merged join hop a on a.id = src join hop b on b.id = dst""")
def triples_by_quotes(spark, sf) -> DataFrame:
    """A node's triples: those nearer to the question first, then those with more quotes."""
    merged = etl.merge_triples(extracted(spark, sf))
    hop = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("hop")).unionByName(read(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("hop")))
    rows = merged.join(hop.select(F.col("id").alias("src"), F.col("hop").alias("a")), "src").join(hop.select(F.col("id").alias("dst"), F.col("hop").alias("b")), "dst").withColumn("near", F.least("a", "b"))
    w = Window.partitionBy("src").orderBy("near", F.desc(F.size("quotes")), "seq", "dst", "kind")
    return rows.select("src", "kind", "dst", F.row_number().over(w).alias("pos"))


@query("with r as (select conv_id, turn, substr(sha1(role || chr(0) || text), 1, 16) as key from conversations), c as (select distinct key from r where turn = 0) select conv_id, turn, r.key, c.key is not null as hit from r left join c using (key)")
def answer_cache(spark, sf) -> DataFrame:
    """Turns whose contents were answered before, by the key of a cached answer."""
    from wayfind.sources.files import cache_key, cached

    asked = read(spark, sf, "conversations").select("conv_id", "turn", cache_key("role", "text").alias("key"))
    known = asked.where("turn = 0").select("key").distinct().withColumn("answer", F.lit("a"))
    return cached(asked, known).select("conv_id", "turn", "key", F.col("answer").isNotNull().alias("hit"))


@query("select event_id from events where event_id not in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def work_remaining(spark, sf) -> DataFrame:
    """What a resumed job still has to do."""
    from wayfind.sources.files import remaining

    return remaining(read(spark, sf, "events").select(F.col("event_id").alias("id")), read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))).select(F.col("id").alias("event_id"))


@query("select (select count(*) from part) as films, (select count(*) from customer) as people, (select count(*) from events) as events")
def table_stats(spark, sf) -> DataFrame:
    return etl.stats(spark, films=films(spark, sf), people=people(spark, sf), events=read(spark, sf, "events"))
