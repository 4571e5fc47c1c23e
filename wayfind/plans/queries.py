"""The registered queries of the library over the given tables, each beside its SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import bm25, bm25_store, etl, evaluate, graph, layout, resolve, route, traverse
from wayfind.operators.shared import shared_folder, stored
from wayfind.plans.tables import HISTORY_SQL, QUESTIONS_SQL, SQL, credits, films, history_edges, history_nodes, labels, nodes, people, questions, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- graph access, projections, counts ---


@query(SQL + " select n.id, count(e.id) as degree from (select id from films union all select id from people) n left join (select src as id from credits union all select dst from credits) e on e.id = n.id group by n.id")
def graph_degree(spark, sf) -> DataFrame:
    return graph.degree(nodes(spark, sf), credits(spark, sf))


@query(SQL + " select id from (select id from films union all select id from people) where id not in (select src from credits union select dst from credits)")
def graph_isolated(spark, sf) -> DataFrame:
    return graph.isolated(nodes(spark, sf), credits(spark, sf))


@query(SQL + " select id, count(*) as degree from (select src as id from credits union all select dst from credits) group by id order by degree desc, id limit 8")
def graph_hubs_topk(spark, sf) -> DataFrame:
    return graph.hubs(graph.degree(nodes(spark, sf), credits(spark, sf)), 8)


@query(SQL + " select kind, count(*) as n from credits group by kind")
def edge_kind_counts(spark, sf) -> DataFrame:
    return graph.kind_counts(credits(spark, sf))


@query(SQL + " select person, count(*) filter (ko) as home, count(*) filter (not ko) as abroad from (select distinct src as person, dst from credits) c join films f on f.id = c.dst group by person having count(*) filter (ko) > 0 and count(*) filter (not ko) > 0")
def health_bridge_people(spark, sf) -> DataFrame:
    return graph.bridge_people(credits(spark, sf), films(spark, sf))


@query(SQL + " select src as node, dst as other, kind, 'out' as dir from credits union all select dst, src, kind, 'in' from credits")
def neighbors_both_dirs(spark, sf) -> DataFrame:
    return graph.neighbors(credits(spark, sf)).drop("seq")


@query(SQL + " select dst as film, src as person, kind, pos from (select *, row_number() over (partition by dst order by case kind when 'DIRECTED' then -2 when 'WROTE' then -1 else ord end, s, d, kind) as pos from credits) where pos <= 5")
def credits_top5(spark, sf) -> DataFrame:
    return graph.top_credits(credits(spark, sf), 5).select(F.col("dst").alias("film"), F.col("src").alias("person"), "kind", "pos")


@query(SQL + " select person, id, popularity, pos from (select person, f.id, popularity, row_number() over (partition by person order by popularity desc, seq) as pos from (select distinct src as person, dst from credits) c join films f on f.id = c.dst) where pos <= 4")
def films_top_k(spark, sf) -> DataFrame:
    return graph.top_films(credits(spark, sf), films(spark, sf), 4)


@query(SQL + ", r as (select *, row_number() over (partition by genre, ko order by popularity desc, seq) as nth from films) select genre, id, row_number() over (partition by genre order by ko desc, nth) as pos from r where nth <= case when ko then 30 else 15 end")
def genre_index_quota(spark, sf) -> DataFrame:
    return graph.genre_index(films(spark, sf))


@query(SQL + " select cast(floor(year / 10) * 10 as int) as decade, count(*) as n from films where ko group by 1")
def decade_histogram(spark, sf) -> DataFrame:
    return films(spark, sf).where("ko").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query(SQL + " select genre, count(*) as n from films group by genre order by n desc, genre limit 10")
def genre_histogram(spark, sf) -> DataFrame:
    return films(spark, sf).select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(10)


@query(SQL + " select id, title, year, ko, genre from films order by popularity desc, seq limit 600")
def thin_graph_top600(spark, sf) -> DataFrame:
    return films(spark, sf).orderBy(F.desc("popularity"), "seq").limit(600).select("id", "title", "year", "ko", F.array_join(F.slice("genres", 1, 2), "/").alias("genre"))


@query(HISTORY_SQL + " select h.id, h.type, d.degree from hnodes h join hdegree d using (id) where d.degree >= 2")
def history_field(spark, sf) -> DataFrame:
    n = history_nodes(spark, sf)
    return n.select("id", "type").join(graph.degree(n, history_edges(spark, sf)), "id").where("degree >= 2").select("id", "type", "degree")


@query(SQL + """, top as (select id as dst from films order by popularity desc, seq limit 600),
acted as (select src, dst, s, d, row_number() over (partition by src order by d) as i, count(*) over (partition by src) as n from credits join top using (dst) where kind = 'ACTED_IN'),
pairs as (select x.dst as a, y.dst as b, x.src, (x.s, x.i, y.i) as place from acted x join acted y on x.src = y.src and x.i < y.i where x.n between 2 and 12)
select a, b, arg_min(src, place) as person from pairs group by a, b order by min(place) limit 4000""")
def coactor_pairs(spark, sf) -> DataFrame:
    return graph.coactor_pairs(credits(spark, sf), films(spark, sf))


# --- search ---

TOKENS_SQL = """
with docs as (select doc_id as id, source as title, text from documents),
toks as (
  select id, unnest(list_concat(regexp_extract_all(lower(title), '[0-9a-z]+'), regexp_extract_all(lower(title), '[0-9a-z]+'), regexp_extract_all(lower(title), '[0-9a-z]+'), regexp_extract_all(lower(text), '[0-9a-z]+'))) as tok from docs),
tf as (select id, tok, count(*) as tf from toks group by id, tok),
len as (select d.id, coalesce(l.n, 0) as len from docs d left join (select id, count(*) as n from toks group by id) l using (id)),
df as (select tok, count(*) as df from tf group by tok)"""


def corpus(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")


def asked(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query("select doc_id as id, len(regexp_extract_all(lower(text), '[0-9a-z]+')) as n_tokens from documents")
def tokenize_counts(spark, sf) -> DataFrame:
    return corpus(spark, sf).select("id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"))


@query(TOKENS_SQL + " select tok, count(*) as df, cast(sum(tf) as bigint) as tf from tf group by tok")
def bm25_df(spark, sf) -> DataFrame:
    return bm25.frequencies(corpus(spark, sf))


BM25_SQL = TOKENS_SQL + """, q as (select item_id as qid, tok, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) as tok from benchmark) group by 1, 2),
t as (select count(*) as n, avg(len) as avg_len from len),
s as (select qid, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score
  from q join tf using (tok) join df using (tok) join len using (id), t group by qid, id),
r as (select *, row_number() over (partition by qid order by score desc, id) as pos from s where score > 0)"""


@query(BM25_SQL + " select qid, id, pos from r where pos <= 10")
def bm25_search_topk(spark, sf) -> DataFrame:
    q = asked(spark, sf)
    return bm25.search(bm25.build_index(corpus(spark, sf), asked=q), q).select("qid", "id", "pos")


@query(BM25_SQL.replace("text from documents)", "text from documents where doc_id % 17 <> 0)") + " select qid, id, score, pos from r where pos <= 10")
def bm25_stored_search(spark, sf) -> DataFrame:
    """The same from an index on disk, to which documents were added twice and from which some were removed."""
    path, docs = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", corpus(spark, sf)
    bm25_store.add(docs.where("id % 10 < 8"), path)
    bm25_store.remove(spark, path, docs.where("id % 17 = 0"))
    bm25_store.add(docs.where("id % 10 >= 7 and id % 17 <> 0"), path)
    return bm25_store.search(spark, path, asked(spark, sf)).select("qid", "id", "score", "pos")


@query(BM25_SQL + ", truth as (select item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)) select k, count(*) filter (pos <= k) as found, count(*) as n from (select t.qid, t.id, r.pos from truth t left join r using (qid, id)), (select unnest([1, 5, 10]) as k) group by k")
def bm25_recall_at_k(spark, sf) -> DataFrame:
    docs, q = corpus(spark, sf), asked(spark, sf)
    truth = etl.verify_quotes(q.withColumnRenamed("qid", "quote_id"), docs).withColumnRenamed("quote_id", "qid")
    found = truth.join(bm25.search(bm25.build_index(docs), q), ["qid", "id"], "left")
    return found.select("pos", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k")).groupBy("k").agg(F.count_if(F.col("pos") <= F.col("k")).alias("found"), F.count("*").alias("n"))


# --- names and titles in questions ---

HITS_SQL = SQL + QUESTIONS_SQL + """,
suffixes as (
  select qid, array_to_string(list_slice(toks, i, len(toks)), '') as s
  from (select qid, toks, unnest(range(1, len(toks) + 1)) as i from (select qid, regexp_split_to_array(lower(trim(question)), '\\s+') as toks from questions))),
labels as (select id, name as label, popularity, seq from people union all select id, left(name, length(name) - 1), popularity, seq from people),
hits as (select distinct s.qid, l.id, l.label, l.popularity, l.seq from suffixes s join labels l on left(s.s, length(l.label)) = lower(l.label)),
best as (select * from (select *, row_number() over (partition by qid, id order by length(label) desc, label) as nth from hits) where nth = 1),
ranked as (select *, row_number() over (partition by qid order by length(label) desc, popularity desc, seq) as r from best),
kept as (select *, row_number() over (partition by qid order by r) as rank from ranked a where not exists (select 1 from ranked b where b.qid = a.qid and b.r < a.r and contains(lower(b.label), lower(a.label))))"""


@query(HITS_SQL + " select qid, id, label from hits")
def mentions_prefix_join(spark, sf) -> DataFrame:
    return resolve.mentioned(questions(spark, sf), labels(spark, sf)).select("qid", "id", "label")


def hits(spark, sf) -> DataFrame:
    return resolve.longest_hits(resolve.mentioned(questions(spark, sf), labels(spark, sf)))


@query(HITS_SQL + " select qid, id, label, rank from kept")
def people_in_question(spark, sf) -> DataFrame:
    return hits(spark, sf).select("qid", "id", "label", "rank")


@query(HITS_SQL + " select qid, (select count(distinct h.id) from hits h where h.qid = q.qid) - count(k.id) as suppressed from questions q left join kept k using (qid) group by qid")
def longest_match_suppression(spark, sf) -> DataFrame:
    q = questions(spark, sf)
    found = resolve.mentioned(q, labels(spark, sf))
    every = found.groupBy("qid").agg(F.countDistinct("id").alias("n"))
    kept = resolve.longest_hits(found).groupBy("qid").agg(F.count("*").alias("k"))
    return q.select("qid").join(every, "qid", "left").join(kept, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) - F.coalesce("k", F.lit(0))).alias("suppressed"))


FIRST_SQL = """, films_of as (select distinct k.qid, k.id as part, c.dst as id from kept k join credits c on c.src = k.id where k.rank <= 3),
n as (select qid, count(*) as n from kept where rank <= 3 group by qid having count(*) > 1),
common as (select qid, id from films_of join n using (qid) group by qid, id, n having count(distinct part) = n),
crossed as (select c.qid, c.id, f.popularity, row_number() over (partition by c.qid order by f.popularity desc, f.seq) as pos from common c join films f using (id))"""


@query(HITS_SQL + FIRST_SQL + " select qid, id, popularity, pos from crossed where pos <= 5")
def people_intersection(spark, sf) -> DataFrame:
    return resolve.people_intersection(hits(spark, sf), credits(spark, sf), films(spark, sf))


@query(SQL + ", p as (select distinct a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1), q as (select a || '|' || b as qid, '《' || a || '》와 《' || b || '》' as question from p) select distinct qid, title from q join (select distinct title from films) t on contains(question, '《' || title || '》')")
def titles_in_question(spark, sf) -> DataFrame:
    q, t = title_questions(spark, sf), films(spark, sf).select("title").distinct()
    # a title in brackets ends where they do: an equi-join
    inside = q.select("qid", F.explode(F.regexp_extract_all("question", F.lit("《([^》]+)》"), 1)).alias("title"))
    return inside.join(t, "title").select("qid", "title").distinct()


def title_questions(spark, sf) -> DataFrame:
    p = read(spark, sf, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("a", "b").distinct()
    return pairs.select(F.concat_ws("|", "a", "b").alias("qid"), F.format_string("《%s》와 《%s》", "a", "b").alias("question"))


@query(SQL + " select title, count(*) as n, count(*) filter (ko) as home from films group by title having count(*) > 1")
def title_homonym_groups(spark, sf) -> DataFrame:
    return films(spark, sf).groupBy("title").agg(F.count("*").alias("n"), F.count_if("ko").alias("home")).where("n > 1")


@query(HITS_SQL + FIRST_SQL + """, seeds as (select qid, pos, id from crossed where pos <= 5),
met as (select a.qid, a.id as anchor, o.id as other, c.src, c.kind, c.ord, c.s, c.d
  from seeds a join seeds o on o.qid = a.qid and o.pos > 1 join credits c on c.dst = o.id join (select distinct src, dst from credits) e on e.dst = a.id and e.src = c.src where a.pos = 1),
one as (select qid, anchor, other, src, arg_max(ord, kind) as ord, max(kind) as kind, min((s, d, kind)) as place from met group by qid, anchor, other, src)
select qid, anchor, other, src as person, kind from (
  select *, row_number() over (partition by qid, other order by asked desc, case when asked then 0 else ord end, place) as nth
  from (select o.*, exists (select 1 from kept k where k.qid = o.qid and k.id = o.src) as asked from one o)) where nth = 1""")
def seed_bridges(spark, sf) -> DataFrame:
    """A person whom the question names comes first, then who is first billed."""
    return resolve.seed_bridges(people_intersection(spark, sf), credits(spark, sf), people=hits(spark, sf))


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace(" ", "").replace("'", "''") + "'" for w in words) + "]"


def route_sql(column: str) -> str:
    cases = " ".join(f"when len(list_filter({sql_list(words)}, lambda w: contains(replace({column}, ' ', ''), w))) > 0 then '{name}'" for name, _, words in route.RULES)
    return f"case {cases} else '{route.FALLBACK[0]}' end"


@query(SQL + QUESTIONS_SQL + f" select qid, {route_sql('question')} as route from questions")
def route_precedence(spark, sf) -> DataFrame:
    return questions(spark, sf).select("qid", route.route(F.col("question"))[0].alias("route"))


def reason_sql(column: str) -> str:
    """The first rule's text and its first word that the question holds."""
    bare, hits = f"regexp_replace({column}, '\\s+', '', 'g')", []
    for _, said, words in route.RULES:
        listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        found = f"list_filter({listed}, lambda w: contains({bare}, regexp_replace(w, '\\s+', '', 'g')))[1]"
        hits.append(f"'{said}' || {found}")
    return f"coalesce({', '.join(hits)}, '{route.FALLBACK[1]}')"


@query(SQL + QUESTIONS_SQL + f" select qid, {route_sql('question')} as route, {reason_sql('question')} as reason from questions")
def route_reasons(spark, sf) -> DataFrame:
    name, reason = route.route(F.col("question"))
    return questions(spark, sf).select("qid", name.alias("route"), reason.alias("reason"))


# --- traversal ---


def film_seeds(spark, sf) -> DataFrame:
    """Each question's seeds: films that its people share, else the first person's most popular ones."""
    found, c, f = hits(spark, sf), credits(spark, sf), films(spark, sf)
    both = resolve.people_intersection(found, c, f).select("qid", "pos", "id")
    alone = found.where("rank = 1").select("qid", F.col("id").alias("person")).join(graph.top_films(c, f, 4), "person").select("qid", "pos", "id")
    return both.unionByName(alone.join(both.select("qid").distinct(), "qid", "left_anti"))


SEEDS_SQL = HITS_SQL + FIRST_SQL + """, seeds as (
  select qid, pos, id from crossed where pos <= 5
  union all
  select k.qid, t.pos, t.id from kept k join (
    select person, f.id, row_number() over (partition by person order by popularity desc, seq) as pos from (select distinct src as person, dst from credits) c join films f on f.id = c.dst) t on t.person = k.id
  where k.rank = 1 and t.pos <= 4 and k.qid not in (select qid from crossed)),
used as (select * from credits where kind in ('ACTED_IN', 'DIRECTED')),
via as (select * from (select dst as film, src as person, row_number() over (partition by dst order by case kind when 'DIRECTED' then -1 else ord end, s, d, kind) as ppos from used) where ppos <= 5)"""


@query(SEEDS_SQL + " select qid, pos, id from seeds")
def seeds_cascade(spark, sf) -> DataFrame:
    return film_seeds(spark, sf)


@query(SQL + ", used as (select * from credits where kind in ('ACTED_IN', 'DIRECTED')), via as (select * from (select dst as film, src as person, row_number() over (partition by dst order by case kind when 'DIRECTED' then -1 else ord end, s, d, kind) as ppos from used) where ppos <= 5) select v.film, u.dst as other, min(v.ppos) as ppos from via v join used u on u.src = v.person where u.dst <> v.film group by v.film, u.dst")
def bridge_1hop(spark, sf) -> DataFrame:
    """The flagship: other films that each film reaches through its first five people."""
    used = credits(spark, sf).where(F.col("kind").isin("ACTED_IN", "DIRECTED"))
    via = graph.top_credits(used, 5, first={"DIRECTED": -1}).select(F.col("dst").alias("film"), F.col("src").alias("person"), F.col("pos").alias("ppos"))
    onward = used.select(F.col("src").alias("person"), F.col("dst").alias("other"))
    return via.join(onward, "person").where("other <> film").groupBy("film", "other").agg(F.min("ppos").alias("ppos"))


def walked(spark, sf, name: str = "bridge", **budget) -> DataFrame:
    kinds, exempt = route.PLANS[name]
    return traverse.expand_through_people(film_seeds(spark, sf), films(spark, sf), credits(spark, sf), people(spark, sf), kinds, exempt, near=film_adjacency(spark, sf, kinds), **budget)


def film_adjacency(spark, sf, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first people of films, bucketed by film, and where people lead, bucketed by person."""
    near = lambda i: lambda: traverse.near_films(films(spark, sf), credits(spark, sf), people(spark, sf), kinds)[i]
    name = "/".join(sorted(kinds))
    return stored(spark, near(0), "via", name, sf, by=("film",)), stored(spark, near(1), "onward", name, sf, by=("person",))


def fold_sql(hops: int, exempt: str, most: int = 10, per: int = 4) -> str:
    """The sequential walk itself: candidate by candidate, until a question is full; the rest is counted as dropped.

    ids, and for each of them the film and the person it was reached by.
    """
    out = SEEDS_SQL.replace("with films", "with recursive films", 1) + """,
st0 as (select qid, list(id order by pos) as ids, list('' order by pos) as srcs, list('' order by pos) as vias, 0 as a, 0 as d, 0 as dropped, 0 as old from seeds group by qid)"""
    for h in range(1, hops + 1):
        full = f"d < {per}" if exempt != "DIRECTED" else "true"
        out += f""",
fr{h} as (select qid, unnest(ids) as film, unnest(range(len(ids))) as fpos, old from st{h - 1} where len(ids) < {most}),
ca{h} as materialized (
  select f.qid, f.film, p.name, u.dst as target, u.kind, row_number() over (partition by f.qid order by f.fpos, v.ppos, u.s, u.d, u.kind) as n
  from fr{h} f join via v on v.film = f.film join used u on u.src = v.person join people p on p.id = v.person where f.fpos >= f.old),
wa{h}(qid, n, ids, srcs, vias, a, d, dropped) as (
  select qid, 0, ids, srcs, vias, a, d, dropped from st{h - 1}
  union all
  select qid, n, case when ok then list_append(ids, target) else ids end, case when ok then list_append(srcs, film) else srcs end, case when ok then list_append(vias, name) else vias end,
    a + cast(ok and kind = 'ACTED_IN' as int), d + cast(ok and kind = 'DIRECTED' as int), dropped + cast(not there and not ok as int)
  from (select w.*, c.n as m, c.film, c.name, c.target, c.kind, list_contains(w.ids, c.target) as there,
          not list_contains(w.ids, c.target) and case when c.kind = 'ACTED_IN' then w.a < {per} else {full} end as ok
        from wa{h} w join ca{h} c on c.qid = w.qid and c.n = w.n + 1 where len(w.ids) < {most}) t(qid, before, ids, srcs, vias, a, d, dropped, n, film, name, target, kind, there, ok)),
la{h} as (select * from wa{h} qualify n = max(n) over (partition by qid)),
st{h} as (
  select l.qid, any_value(l.ids) as ids, any_value(l.srcs) as srcs, any_value(l.vias) as vias, any_value(l.a) as a, any_value(l.d) as d,
    any_value(l.dropped) + count(c.n) filter (not list_contains(l.ids, c.target)) as dropped, any_value(len(s.ids)) as old
  from la{h} l join st{h - 1} s using (qid) left join ca{h} c on c.qid = l.qid and c.n > l.n group by l.qid)"""
    return out


def hop_of(hops: int) -> str:
    """The hop of place i (from 0) of st{hops}.ids, from the sizes before each hop."""
    return "case " + " ".join(f"when i < (select len(z.ids) from st{h} z where z.qid = s.qid) then {h}" for h in range(hops)) + f" else {hops} end"


def walk_sql(hops: int, exempt: str) -> str:
    return fold_sql(hops, exempt) + f" select qid, i as pos, id, {hop_of(hops)} as hop from (select qid, unnest(range(len(ids))) as i, unnest(ids) as id from st{hops}) s"


@query(walk_sql(1, "DIRECTED"))
def bridge_1hop_budgeted(spark, sf) -> DataFrame:
    return traverse.evidence(walked(spark, sf, max_hops=1)).select("qid", "pos", "id", "hop")


@query(walk_sql(2, "DIRECTED"))
def bridge_2hop_budgeted(spark, sf) -> DataFrame:
    return traverse.evidence(walked(spark, sf)).select("qid", "pos", "id", "hop")


@query(fold_sql(2, "DIRECTED") + " select s.qid, len(z.ids) as n_seeds, len(s.ids) as n_nodes, cast(s.dropped as bigint) as dropped from st2 s join st0 z using (qid)")
def bridge_dropped_counts(spark, sf) -> DataFrame:
    return walked(spark, sf).select("qid", F.col("n_seeds").cast("long").alias("n_seeds"), F.size("ids").cast("long").alias("n_nodes"), "dropped")


@query(walk_sql(2, ""))
def similar_2hop_budgeted(spark, sf) -> DataFrame:
    return traverse.evidence(walked(spark, sf, "similar")).select("qid", "pos", "id", "hop")


@query(fold_sql(2, "DIRECTED") + """, flat as (select qid, unnest(ids) as id, unnest(srcs) as src, unnest(vias) as via from st2)
select f.qid, f.id, case when g.src = '' then f.src || ' ─' || f.via || '─▶ ' || f.id else g.src || ' ─' || g.via || '─▶ ' || f.src || ' ─' || f.via || '─▶ ' || f.id end as path
from flat f join flat g on g.qid = f.qid and g.id = f.src where f.src <> ''""")
def path_strings(spark, sf) -> DataFrame:
    found = traverse.evidence(walked(spark, sf)).where("hop > 0")
    hops = F.transform("path", lambda h: F.struct(h["via"].alias("via"), h["dst"].alias("dst")))
    return found.select("qid", "id", graph.describe_path(F.get("path", F.lit(0))["src"], hops).alias("path"))


def history_seeds(spark, sf) -> DataFrame:
    """A question for each customer: the customer, and its nation where it is its first member."""
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("qid"), F.lit(1).alias("pos"), F.concat(F.lit("c"), "c_custkey").alias("id"))


def history_walk(spark, sf, hub_top: int = 8, **budget) -> DataFrame:
    n, e = history_nodes(spark, sf), history_edges(spark, sf)
    near = history_adjacency(spark, sf)
    return traverse.expand_undirected(history_seeds(spark, sf), n, e, graph.hubs(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), hub_top), near=near, **budget)


def history_adjacency(spark, sf) -> DataFrame:
    """Every edge from both ends, bucketed by the end it is read from."""
    return stored(spark, lambda: traverse.near_edges(history_edges(spark, sf)), "near", sf, by=("src",))


HISTORY_WALK_SQL = HISTORY_SQL.replace("with hnodes", "with recursive hnodes", 1) + """, hubs as (select id from hdegree order by degree desc, id limit 8),
near as (select src as node, dst as other, kind, 0 as inward, src, dst from hedges union all select dst, src, kind, 1, src, dst from hedges),
st0 as (select c_custkey as qid, ['c' || c_custkey] as ids, 0 as p, 0 as a, 0 as m, 0 as dropped, 0 as old from customer)""" + "".join(f""",
fr{h} as (select qid, unnest(ids) as node, unnest(range(len(ids))) as fpos, old from st{h - 1} where len(ids) < 80),
ca{h} as materialized (select f.qid, e.other as target, e.kind, row_number() over (partition by f.qid order by f.fpos, e.inward, e.kind, e.src, e.dst) as n from fr{h} f join near e on e.node = f.node where f.fpos >= f.old and ({h} = 1 or f.node not in (select id from hubs))),
wa{h}(qid, n, ids, p, a, m, dropped) as (
  select qid, 0, ids, p, a, m, dropped from st{h - 1}
  union all
  select w.qid, c.n, case when not list_contains(w.ids, c.target) and (case c.kind when 'PARTICIPATED_IN' then w.p when 'AFFECTED' then w.a else w.m end) < 12 then list_append(w.ids, c.target) else w.ids end,
    w.p + cast(c.kind = 'PARTICIPATED_IN' and w.p < 12 and not list_contains(w.ids, c.target) as int), w.a + cast(c.kind = 'AFFECTED' and w.a < 12 and not list_contains(w.ids, c.target) as int), w.m + cast(c.kind = 'MEMBER_OF' and w.m < 12 and not list_contains(w.ids, c.target) as int),
    w.dropped + cast(not list_contains(w.ids, c.target) and (case c.kind when 'PARTICIPATED_IN' then w.p when 'AFFECTED' then w.a else w.m end) >= 12 as int)
  from wa{h} w join ca{h} c on c.qid = w.qid and c.n = w.n + 1 where len(w.ids) < 80),
st{h} as (select l.qid, any_value(l.ids) as ids, any_value(l.p) as p, any_value(l.a) as a, any_value(l.m) as m, any_value(l.dropped) as dropped, any_value(len(s.ids)) as old from (select * from wa{h} qualify n = max(n) over (partition by qid)) l join st{h - 1} s using (qid) group by l.qid)""" for h in (1, 2))


@query(HISTORY_WALK_SQL + f" select qid, i as pos, id, {hop_of(2)} as hop from (select qid, unnest(range(len(ids))) as i, unnest(ids) as id from st2) s")
def history_2hop_budgeted(spark, sf) -> DataFrame:
    return traverse.evidence(history_walk(spark, sf)).select("qid", "pos", "id", "hop")


@query(HISTORY_WALK_SQL + " select s.qid, cast(s.dropped as bigint) as dropped from st2 s")
def history_dropped_counts(spark, sf) -> DataFrame:
    return history_walk(spark, sf).select("qid", "dropped")


@query(HISTORY_SQL + """, hubs as (select id from hdegree order by degree desc, id limit 8),
near as (
  select 'c' || c_custkey as src, c_custkey as qid from customer),
first as (
  select n.qid, e.dst as id, e.kind, row_number() over (partition by n.qid, e.kind order by e.src, e.dst) as nth from near n join hedges e on e.src = n.src),
reached as (select qid, id from first where nth <= 12)
select qid, count(r.id) filter (r.id in (select id from hubs)) as blocked from near left join reached r using (qid) group by qid""")
def history_hub_blocked(spark, sf) -> DataFrame:
    """Customers have only outgoing edges of two kinds, so that a hop is 12 of each at most."""
    return history_walk(spark, sf).select("qid", F.col("blocked").cast("long").alias("blocked"))


@query(HISTORY_SQL + """, u as (select src as a, dst as b from hedges union all select dst, src from hedges), hubs as (select id from hdegree order by degree desc, id limit 8),
one as (select 'c' || c_custkey as node, b as id from customer join u on u.a = 'c' || c_custkey)
select node, count(distinct id) as reached from (select node, id from one union select o.node, u.b from one o join u on u.a = o.id where o.id not in (select id from hubs) and u.b <> o.node) group by node""")
def reach_within_2hops(spark, sf) -> DataFrame:
    """How many nodes each customer reaches in two hops that don't pass a hub, without budgets."""
    n, near = history_nodes(spark, sf), history_adjacency(spark, sf).select("src", "target")
    hubs = graph.hubs(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), 8)
    return traverse.reach_two_hops(n.where("type = 'Person'").select("id"), near, hubs).select(F.col("id").alias("node"), "reached")


EVIDENCE_SQL = SEEDS_SQL + ", ev as (select distinct qid, id from seeds union select distinct k.qid, k.id from kept k)"


def small_evidence(spark, sf) -> DataFrame:
    """Seeds (hop 1) and the people named (hop 0) of each question."""
    people_hit = hits(spark, sf).select("qid", "id", F.lit(0).alias("hop"))
    return film_seeds(spark, sf).select("qid", "id", F.lit(1).alias("hop")).unionByName(people_hit).distinct()


@query(EVIDENCE_SQL + " select a.qid, c.src, c.dst, c.kind from ev a join credits c on c.src = a.id join ev b on b.qid = a.qid and b.id = c.dst")
def triples_in_evidence(spark, sf) -> DataFrame:
    return traverse.triples(small_evidence(spark, sf), credits(spark, sf)).select("qid", "src", "dst", "kind")


@query(EVIDENCE_SQL + " select qid, src, dst, kind, row_number() over (partition by qid order by ord, s, d, kind) as pos from (select a.qid, c.* from ev a join credits c on c.src = a.id join ev b on b.qid = a.qid and b.id = c.dst)")
def triple_order(spark, sf) -> DataFrame:
    """Triples by the hops of their nearer end (here one of them is always named), then by credit order."""
    w = Window.partitionBy("qid").orderBy("near", "ord", "seq")
    return traverse.triples(small_evidence(spark, sf), credits(spark, sf)).select("qid", "src", "dst", "kind", F.row_number().over(w).alias("pos"))


@query(EVIDENCE_SQL + " select qid, count(distinct src) as sources, count(*) as triples from (select a.qid, c.src from ev a join credits c on c.src = a.id join ev b on b.qid = a.qid and b.id = c.dst) group by qid")
def sources_distinct(spark, sf) -> DataFrame:
    return traverse.triples(small_evidence(spark, sf), credits(spark, sf)).groupBy("qid").agg(F.countDistinct("src").alias("sources"), F.count("*").alias("triples"))


#: Films and quota of the swept walks.
SWEEP = [(most, per) for most in (5, 10) for per in (2, 4)]


def sweep_sql() -> str:
    """The walk's CTEs once for each setting, their names told apart."""
    import re

    head = SEEDS_SQL.replace("with films", "with recursive films", 1)
    parts, picks = [], []
    for i, (most, per) in enumerate(SWEEP):
        body = fold_sql(1, "DIRECTED", most, per)[len(head) :]
        parts.append(re.sub(r"\b(st|fr|ca|wa|la)([01])\b", rf"\1\2_{i}", body))
        picks.append(f"select {most} as most, {per} as per_kind, round(avg(len(ids)), 6) as mean_evidence, cast(sum(dropped) as bigint) as dropped from st1_{i}")
    return head + "".join(parts) + " " + " union all ".join(picks)


@query(sweep_sql())
def sweep_grid(spark, sf) -> DataFrame:
    """Evidence and drops for each setting of films and quota, over all questions: one walk, keyed by setting."""
    settings = spark.createDataFrame([(f"{m}/{p}", m, p, 1) for m, p in SWEEP], "cfg string, most int, per_kind int, max_hops int")
    return walked(spark, sf, settings=settings).groupBy("most", "per_kind").agg(F.round(F.avg(F.size("ids")), 6).alias("mean_evidence"), F.sum("dropped").alias("dropped"))


# --- batch work ---


@query("select b.item_id as quote_id, d.doc_id as id from benchmark b join documents d on contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))")
def quote_verification(spark, sf) -> DataFrame:
    return etl.verify_quotes(asked(spark, sf).withColumnRenamed("qid", "quote_id"), corpus(spark, sf))


@query(HISTORY_SQL + ", t as (select a.type as src_type, e.kind, b.type as dst_type from hedges e join hnodes a on a.id = e.src join hnodes b on b.id = e.dst) select kind, case when (kind in ('PARTICIPATED_IN') and src_type = 'Person' and dst_type = 'Event') or (kind = 'MEMBER_OF' and src_type = 'Person' and dst_type = 'Organization') or (kind = 'AFFECTED' and src_type = 'Event' and dst_type = 'Organization') then 'ok' else 'type' end as error, count(*) as n from t group by 1, 2")
def type_signature_check(spark, sf) -> DataFrame:
    kind = history_nodes(spark, sf).select("id", "type")
    e = history_edges(spark, sf).join(kind.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(kind.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    return etl.signature_errors(e).groupBy("kind", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


DROP_NAMES = ["관찰사", "육군 장관", "미국", "히틀러", "a", "시장 상인", "의원"]


@query(f"""with e as (select distinct o_custkey as a, l_suppkey as b from orders join lineitem on o_orderkey = l_orderkey),
n as (select case when a % 3 = 0 then list_extract({DROP_NAMES!r}, cast(a % 7 + 1 as int)) else 'c' || a end as src, case when b % 5 = 0 then list_extract({DROP_NAMES!r}, cast(b % 7 + 1 as int)) else 'c' || b end as dst from e)
select case when regexp_matches(src, '{etl.OFFICE}') or regexp_matches(dst, '{etl.OFFICE}') then 'office' when src in ({", ".join("'" + x + "'" for x in etl.FOREIGN)}) or dst in ({", ".join("'" + x + "'" for x in etl.FOREIGN)}) then 'foreign'
  when src = dst then 'self' when length(src) < 2 or length(dst) < 2 then 'short' else 'kept' end as reason, count(*) as n from n group by 1""")
def drop_reason_counts(spark, sf) -> DataFrame:
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")).join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("b")), "k").select("a", "b").distinct()
    name = lambda c, n: F.when(F.col(c) % n == 0, F.element_at(F.array(*map(F.lit, DROP_NAMES)), (F.col(c) % 7 + 1).cast("int"))).otherwise(F.concat(F.lit("c"), c))
    rows = etl.drop_reasons(e.select(name("a", 3).alias("src"), name("b", 5).alias("dst")))
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def extracted(spark, sf) -> DataFrame:
    """Customer to part as if extracted from orders: a quote (ship date) and a document (order) for each line."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line = read(spark, sf, "lineitem").join(o, "l_orderkey")
    return line.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("quote"), F.col("l_orderkey").cast("string").alias("doc"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


EXTRACTED_SQL = "with x as (select 'c' || o_custkey as src, l_returnflag as kind, 'p' || l_partkey as dst, strftime(l_shipdate, '%Y-%m-%d') as quote, cast(l_orderkey as varchar) as doc, l_orderkey as k, l_linenumber as n, l_partkey as p, l_suppkey as s from lineitem join orders on o_orderkey = l_orderkey)"


@query(EXTRACTED_SQL + """ select src, kind, dst, (select string_agg(quote, '|' order by k, n, p, s) from (select quote, k, n, p, s, row_number() over (partition by quote order by k, n, p, s) as nth from unnest(list_zip(qs, ks, ns, ps, ss)) t(u), lateral (select u[1] as quote, u[2] as k, u[3] as n, u[4] as p, u[5] as s)) where nth = 1) as quotes, n_docs
from (select src, kind, dst, list(quote) as qs, list(k) as ks, list(n) as ns, list(p) as ps, list(s) as ss, count(distinct doc) as n_docs from x group by src, kind, dst)""")
def triple_merge(spark, sf) -> DataFrame:
    return etl.merge_triples(extracted(spark, sf)).select("src", "kind", "dst", F.array_join("quotes", "|").alias("quotes"), F.size("docs").cast("long").alias("n_docs"))


@query(EXTRACTED_SQL + ", c as (select src, kind, count(*) as n, min((k, n, p, s)) as first from x group by src, kind) select src, kind, n from (select *, row_number() over (partition by src order by n desc, first) as nth from c) where nth = 1")
def type_majority_vote(spark, sf) -> DataFrame:
    return etl.majority(extracted(spark, sf), "src", "kind")


@query("with c as (select l_suppkey as s, p_name as form, count(*) as n, min((l_orderkey, l_linenumber, l_partkey)) as first from lineitem join part on p_partkey = l_partkey group by 1, 2) select s, form, n from (select *, row_number() over (partition by s order by n desc, length(form), first) as nth from c) where nth = 1")
def surface_form_vote(spark, sf) -> DataFrame:
    votes = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("s"), F.col("p_name").alias("form"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return etl.majority(votes, "s", "form", F.length("form"))


RESPECT_SQL = " ".join(f"when suffix(clean, '{x}') and length(clean) - {len(x)} >= 2 and (select count(*) from canon c where c.k = lower(replace(left(clean, length(clean) - {len(x)}), ' ', ''))) > 0 then (select min(title) from canon c where c.k = lower(replace(left(clean, length(clean) - {len(x)}), ' ', '')))" for x in etl.RESPECT)


@query(f"""with canon as (select p_name as title, lower(replace(p_name, ' ', '')) as k from part where p_size % 2 = 0 group by p_name),
raw as (select surface, count(*) as n, min(p_partkey) as seq from (select p_partkey, unnest([p_name, split_part(p_name, ' ', 1), p_name || ' 대통령', p_name || '대왕', p_type, lower(p_type), p_type || '왕', left(p_name, 2)]) as surface from part) group by surface),
a as (select *, trim(regexp_replace(surface, '{etl.HONORIFICS}', '')) as clean from raw),
r as (select *, lower(replace(clean, ' ', '')) as k from a),
x as (select r.*, (select title from canon c where c.k = r.k) as exact, (select case when count(*) = 1 and length(r.clean) >= 3 then min(title) end from canon c where contains(c.k, r.k)) as partial, case {RESPECT_SQL} end as respect from r),
f as (select k, clean, sum(n) as n, min(seq) as first from x where exact is null and partial is null and respect is null group by k, clean),
u as (select k, clean as usual from (select *, row_number() over (partition by k order by n desc, length(clean), first) as nth from f) where nth = 1)
select surface, coalesce(exact, partial, respect, usual, clean) as resolved, case when exact is not null then 'exact' when partial is not null then 'partial' when respect is not null then 'respect' when usual <> clean then 'surface' else 'itself' end as how from x left join u using (k)""")
def canonical_resolution(spark, sf) -> DataFrame:
    p = read(spark, sf, "part")
    canon = p.where("p_size % 2 = 0").select(text.key(F.col("p_name")).alias("key"), F.col("p_name").alias("title"), F.col("p_partkey").alias("seq"))
    forms = F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat("p_name", F.lit(" 대통령")), F.concat("p_name", F.lit("대왕")), "p_type", F.lower("p_type"), F.concat("p_type", F.lit("왕")), F.substring("p_name", 1, 2))
    surfaces = p.select("p_partkey", F.explode(forms).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"), F.min("p_partkey").alias("seq"))
    return etl.resolve(surfaces, canon)


@query(r"""with d as (select doc_id, case doc_id % 4 when 0 then '그의 호(號)는 도산 (島山)이다' when 1 then '호는 백범이다' when 2 then '호는 산' else text end as body from documents),
e as (select doc_id, coalesce(nullif(regexp_extract(left(body, 3000), '호(?:\(號\))?는\s*([가-힣]{1,4})\s*[(（]', 1), ''), nullif(regexp_extract(left(body, 3000), '호는\s*([가-힣]{2,4})', 1), '')) as pen from d) select doc_id, case when length(pen) >= 2 then pen end as pen from e""")
def pen_names(spark, sf) -> DataFrame:
    k = F.col("doc_id") % 4
    body = F.when(k == 0, "그의 호(號)는 도산 (島山)이다").when(k == 1, "호는 백범이다").when(k == 2, "호는 산").otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", etl.pen_name(body).alias("pen"))


@query(SQL + ", prev as (select src as qid, dst as id, row_number() over (partition by src order by s, d, kind) - 1 as pos from credits where kind = 'ACTED_IN') select qid, cast(pos as int) as pos, id from prev join films using (id) where seq % 5 <> 0")
def previous_answer(spark, sf) -> DataFrame:
    """The films of a previous answer in its order, without those that are no longer known."""
    told = credits(spark, sf).where("kind = 'ACTED_IN'").groupBy(F.col("src").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "dst"))), lambda x: x["dst"]).alias("ids"))
    return resolve.in_order(told, films(spark, sf).where("seq % 5 <> 0").select("id")).select("qid", "pos", "id")


COMPONENT_SQL = HISTORY_SQL.replace("with hnodes", "with recursive hnodes", 1) + """, links as (select src as a, dst as b from hedges where kind = 'MEMBER_OF' union all select dst, src from hedges where kind = 'MEMBER_OF'),
reach(id, root) as (select id, id from hnodes where type <> 'Event' union select l.b, r.root from reach r join links l on l.a = r.id where r.root < l.b)"""


@query(COMPONENT_SQL + " select id, min(root) as component from reach group by id")
def connected_components(spark, sf) -> DataFrame:
    """Components of the membership edges alone, without events, as in the SQL; history_components has those of the whole graph."""
    n, e = history_nodes(spark, sf).where("type <> 'Event'"), history_edges(spark, sf).where("kind = 'MEMBER_OF'")
    return etl.components(n, e)


@query()
def history_components(spark, sf) -> DataFrame:
    """Components of the whole history graph: all nodes, all kinds of edges."""
    return etl.components(history_nodes(spark, sf), history_edges(spark, sf))


@query(HISTORY_SQL + """, d as (select avg(degree) as mean_degree from hdegree), s as (select count(*) as bridges from (select dst from hedges where kind = 'AFFECTED' group by dst having count(*) >= 2)),
w as (select min(n) as within_era from (select a.era, count(*) as n from hedges e join hnodes a on a.id = e.src join hnodes b on b.id = e.dst where kind = 'PARTICIPATED_IN' group by a.era))
select round(mean_degree, 6) as mean_degree, bridges, within_era, mean_degree >= 5 and bridges >= 50 and within_era >= 50 as passes from d, s, w""")
def density_gate(spark, sf) -> DataFrame:
    """The SQL leaves out the share of the largest component, which counts here."""
    n, e = history_nodes(spark, sf), history_edges(spark, sf)
    mean = graph.degree(n, e).where("degree > 0").agg(F.avg("degree").alias("mean_degree"))
    bridges = e.where("kind = 'AFFECTED'").groupBy("dst").count().where("count >= 2").agg(F.count("*").alias("bridges"))
    within = e.where("kind = 'PARTICIPATED_IN'").join(n.select(F.col("id").alias("src"), "era"), "src").groupBy("era").count().agg(F.min("count").alias("within_era"))
    one = mean.crossJoin(bridges).crossJoin(within).crossJoin(etl.largest_share(n, e))  # one row each
    return one.select(F.round("mean_degree", 6).alias("mean_degree"), "bridges", "within_era", etl.gate(F.col("mean_degree"), F.col("largest"), F.col("bridges"), F.col("within_era")).alias("passes"))


@query(HISTORY_SQL + " select case when a.era is null and b.era is null then 'none' when a.era is null or b.era is null then 'half' when a.era = b.era then 'same' else 'cross' end as bucket, count(*) as n from hedges e join hnodes a on a.id = e.src join hnodes b on b.id = e.dst group by 1")
def era_edge_buckets(spark, sf) -> DataFrame:
    n = history_nodes(spark, sf)
    e = history_edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("era").alias("src_era")), "src").join(n.select(F.col("id").alias("dst"), F.col("era").alias("dst_era")), "dst")
    return etl.era_buckets(e)


@query("with t as (select lang, doc_id, source = 'src0' as seed, length(text) as size from documents where length(text) >= 800) select lang, doc_id, pos from (select *, row_number() over (partition by lang order by seed desc, size desc, doc_id) as pos from t) where pos <= 35")
def era_quota_selection(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select("lang", "doc_id", (F.col("source") == "src0").alias("seed"), F.length("text").alias("size")).where("size >= 800")
    return etl.quota_selection(d, "lang", [F.desc("seed"), F.desc("size"), F.col("doc_id")], 35).select("lang", "doc_id", "pos")


@query(HISTORY_SQL + " select node, dir, kind, n from (select node, dir, kind, count(*) as n from (select src as node, 'out' as dir, kind from hedges union all select dst, 'in', kind from hedges) group by 1, 2, 3)")
def neighbor_groups(spark, sf) -> DataFrame:
    return graph.neighbors(history_edges(spark, sf)).groupBy("node", "dir", "kind").agg(F.count("*").alias("n"))


# --- conversation ---


@query("with p as (select conv_id, turn, role, length(text) as size from conversations) select conv_id, turn, role, size, lag(role) over w as previous_role, lag(size) over w as previous_size from p window w as (partition by conv_id order by turn, role, size)")
def conversation_previous(spark, sf) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "size")
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return c.select("conv_id", "turn", "role", "size", F.lag("role").over(w).alias("previous_role"), F.lag("size").over(w).alias("previous_size"))


FOLLOW = "그중에 최근 한국 영화만 평점 높은 순으로"


@query(SQL + ", prev as (select src as qid, f.*, row_number() over (partition by src order by popularity desc, seq) as pos from (select distinct src, dst from credits) c join films f on f.id = c.dst) select qid, id, row_number() over (partition by qid order by -popularity, -year, pos) as new_pos from prev where ko and pos <= 30")
def followup_filters(spark, sf) -> DataFrame:
    """The question FOLLOW asked of each person's 30 most popular films."""
    ok, filters, _ = route.follow_up(F.lit(FOLLOW), F.lit(True))
    previous = graph.top_films(credits(spark, sf), films(spark, sf), 30).select(F.col("person").alias("qid"), "id", "pos").join(films(spark, sf).withColumnRenamed("popularity", "rating"), "id")
    return route.apply_filters(previous.withColumn("filters", filters).where(ok), route.GENRES).select("qid", "id", "new_pos")


# --- evaluation ---

ITEMS_SQL = "with truth as (select b.item_id, d.doc_id, d.lang, d.source from benchmark b join documents d on contains(d.text, b.text)), items as (select d.doc_id, d.lang, d.source, l.quality, l.toxic, t.doc_id is not null as hit from documents d left join (select doc_id, any_value(quality) as quality, any_value(toxic) as toxic from labels group by doc_id) l using (doc_id) left join (select distinct doc_id from truth) t using (doc_id))"


def items(spark, sf) -> DataFrame:
    """Documents with their labels; hit where a benchmark item stands in them."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    label = read(spark, sf, "labels").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    truth = etl.verify_quotes(asked(spark, sf).withColumnRenamed("qid", "quote_id"), corpus(spark, sf)).select(F.col("id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    return d.join(label, "doc_id", "left").join(truth, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query(ITEMS_SQL + " select lang, source, count(*) filter (hit) as hits, count(*) as n, round(count(*) filter (hit) / count(*), 6) as recall from items group by grouping sets ((lang), (source), ())")
def recall_by_grouping_sets(spark, sf) -> DataFrame:
    return evaluate.recall_tables(items(spark, sf), "hit", "lang", "source")


@query(ITEMS_SQL + " select coalesce(quality = 1, false) as evidence, hit as answer, count(*) as n from items group by 1, 2")
def evidence_contingency(spark, sf) -> DataFrame:
    return evaluate.contingency(items(spark, sf).withColumn("good", F.coalesce(F.col("quality") == 1, F.lit(False))), "good", "hit")


@query(SEEDS_SQL + f" select route, count(*) as n, round(count(*) filter (route = 'out_of_scope' or not found) / count(*), 6) as refusal_rate from (select {route_sql('question')} as route, exists (select 1 from seeds s where s.qid = q.qid) as found from questions q) group by grouping sets ((route), ())")
def refusal_rate(spark, sf) -> DataFrame:
    """How many questions are refused: out of scope, or without a film to begin with."""
    n = film_seeds(spark, sf).groupBy("qid").agg(F.count("*").alias("seeds"))
    q = questions(spark, sf).join(n, "qid", "left").select(route.route(F.col("question"))[0].alias("route"), F.coalesce("seeds", F.lit(0)).alias("seeds"))
    q = q.withColumn("refused", route.can_answer(F.col("route"), F.col("seeds"), F.col("seeds")).isNotNull())
    return q.groupingSets([["route"], []], "route").agg(F.count("*").alias("n"), F.round(F.count_if("refused") / F.count("*"), 6).alias("refusal_rate"))


@query(SQL + """, p as (select src as person, f.id, row_number() over (partition by src order by popularity desc, seq) as pos from (select distinct src, dst from credits) c join films f on f.id = c.dst),
w as (select a.person, a.pos, exists (select 1 from credits x join credits y on x.src = y.src and x.kind = 'DIRECTED' and y.kind = 'DIRECTED' where x.dst = a.id and y.dst = b.id) as met from p a join p b on b.person = a.person and b.pos = a.pos + 1 where a.pos <= 3)
select person, round(count(*) filter (met) / count(*), 6) as recall from w group by person""")
def path_recall(spark, sf) -> DataFrame:
    """Of each person's four first films as a written path: the share of steps that share a director."""
    top = graph.top_films(credits(spark, sf), films(spark, sf), 4)
    names = top.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    written = names.select("person", evaluate.path_names(F.array_join("ids", " ─LED─▶ ")).alias("names"))
    steps = written.select("person", F.explode(F.transform(F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))), lambda b, i: F.struct(F.get("names", i).alias("a"), b.alias("b")))).alias("s")).select("person", "s.a", "s.b")
    directed = credits(spark, sf).where("kind = 'DIRECTED'").select("src", "dst")
    pairs = steps.select("a", "b").distinct()
    met = pairs.join(directed.withColumnRenamed("dst", "a"), "a").join(directed.withColumnRenamed("dst", "b"), ["b", "src"]).select("a", "b").distinct()
    walked_pairs = steps.join(met, ["a", "b"]).groupBy("person").agg(F.collect_set(F.concat_ws("|", "a", "b")).alias("walked"))
    return written.join(walked_pairs, "person", "left").select("person", F.round(evaluate.pair_recall(F.col("names"), F.coalesce("walked", F.array().cast("array<string>"))), 6).alias("recall")).where("recall is not null")


# --- names and pictures ---


def hangul_names(spark, sf) -> DataFrame:
    """A Hangul syllable that follows from each customer's key."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    code = F.lit(0xAC00) + F.pmod("c_custkey", F.lit(7)) * 588 * 2 + F.pmod("c_custkey", F.lit(587))
    return c.withColumn("code", code.cast("long")).withColumn("hangul", F.decode(F.unhex(F.concat(F.lit(""), F.hex((F.lit(0xE0) + F.shiftright("code", 12))), F.hex(F.lit(0x80) + F.shiftright("code", 6).bitwiseAND(F.lit(63))), F.hex(F.lit(0x80) + F.col("code").bitwiseAND(F.lit(63))))), "UTF-8"))


@query(f"with c as (select c_custkey as id, 44032 + c_custkey % 7 * 1176 + c_custkey % 587 as code from customer) select id, list_extract({text.INITIALS!r}, cast((code - 44032) // 588 + 1 as int)) || list_extract({text.VOWELS!r}, cast((code - 44032) % 588 // 28 + 1 as int)) || list_extract({text.FINALS!r}, cast((code - 44032) % 28 + 1 as int)) as roman from c")
def syllable_decompose(spark, sf) -> DataFrame:
    return hangul_names(spark, sf).select(F.col("c_custkey").alias("id"), F.array_join(text.syllables(F.col("hangul")), "").alias("roman"))


def alike_sql(c: str) -> str:
    """text.alike; a look-ahead, which DuckDB's patterns don't have, as a condition."""
    for pattern, by in text.ALIKE:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')" if "(?=" not in pattern else f"regexp_replace({c}, '^li', 'i')"
    return c


SQUASH = "array_to_string(list_transform(list_filter(list_zip({0}, range(len({0}))), lambda z: z[2] = 0 or {0}[z[2]] <> z[1]), lambda z: z[1]), '')"


@query(f"""with w as (select p_partkey as id, lower(p_name || ' ' || p_type) as name, list_filter(string_split_regex(p_name || ' ' || p_type, '[ \\-/,()]+'), lambda x: x <> '') as ws from part),
f as (select id, string_split({alike_sql("name")}, '') as cs, list_filter(list_transform(ws, lambda x: {alike_sql("lower(x)")}), lambda x: x <> '') as parts from w)
select id, array_to_string(cs, '') as alike, {SQUASH.format("cs")} as loose, array_to_string(parts, ' ') as parts from f""")
def name_forms(spark, sf) -> DataFrame:
    """Names as they are compared: spelt alike, without doubled letters, and part by part."""
    name = F.concat_ws(" ", "p_name", "p_type")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alike(name).alias("alike"), text.loose(name).alias("loose"), F.array_join(text.roman_parts(name), " ").alias("parts"))


@query("""with t as (select p_partkey as k, case p_partkey % 3 when 0 then p_name when 1 then split_part(p_name, ' ', 1) else '' end as title from part)
select a.k as id, a.title <> '' and b.title <> '' and (a.title = b.title or starts_with(a.title, b.title) or starts_with(b.title, a.title)) as same from t a join t b on b.k = a.k + 1""")
def titles_agree(spark, sf) -> DataFrame:
    """Whether the titles of films that follow each other are equal, or one begins with the other."""
    k = F.col("p_partkey")
    t = read(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("").alias("title"))
    after = t.select((F.col("id") - 1).alias("id"), F.col("title").alias("after"))
    return t.join(after, "id").select("id", evaluate.has_title(F.col("title"), F.col("after")).alias("same"))


@query()
def name_matches_romanized(spark, sf) -> DataFrame:
    """Each customer's Hangul syllable against its neighbour's in Roman letters."""
    h = hangul_names(spark, sf)
    roman = h.select((F.col("c_custkey") - 1).alias("c_custkey"), F.concat(F.lit("Kim "), F.array_join(text.syllables(F.col("hangul")), "")).alias("roman"))
    own = h.select("c_custkey", "hangul", F.concat(F.lit("Kim "), F.array_join(text.syllables(F.col("hangul")), "")).alias("own"))
    return own.join(roman, "c_custkey").select(F.col("c_custkey").alias("id"), text.name_matches(F.col("hangul"), F.col("own")).alias("same"), text.name_matches(F.col("hangul"), F.col("roman")).alias("next"))


@query(HITS_SQL + f""", t as (select qid, id, 0 as hop, rank as pos from kept),
n as (select *, count(*) over (partition by qid, hop) as n, row_number() over (partition by qid, hop order by pos) - 1 as i from t)
select qid as "group", id, hop, round(case when n = 1 then 0.0 else greatest(24.0, n * 24 / {2 * math.pi!r}) end * cos(i / n * {2 * math.pi!r}), 6) as x, cast(-30 * hop as double) as y, round(case when n = 1 then 0.0 else greatest(24.0, n * 24 / {2 * math.pi!r}) end * sin(i / n * {2 * math.pi!r}), 6) as z from n""")
def viz_circle_layout(spark, sf) -> DataFrame:
    return layout.rings(hits(spark, sf).select(F.col("qid").alias("group"), "id", F.lit(0).alias("hop"), F.col("rank").alias("pos")))


@query(f"with t as (select p_type as g, 'movie:' || p_partkey as id, row_number() over (partition by p_type order by p_retailprice desc, 'movie:' || p_partkey) - 1 as i, count(*) over (partition by p_type) as n from part) select g as \"group\", id, round(150 * sqrt(i / n) * cos(i * {math.pi * (3 - math.sqrt(5))!r}), 6) as x, round(150 * sqrt(i / n) * sin(i * {math.pi * (3 - math.sqrt(5))!r}), 6) as z from t")
def viz_spiral_layout(spark, sf) -> DataFrame:
    return layout.spiral(films(spark, sf).select(F.explode("genres").alias("group"), "id", "popularity"), "popularity")


@query(SQL + " select person, id, pos from (select person, f.id, row_number() over (partition by person order by awarded desc, popularity desc, seq) as pos from (select distinct src as person, dst from credits) c join films f on f.id = c.dst) where pos <= 6")
def award_pick(spark, sf) -> DataFrame:
    """Each person's films, awarded ones first, then the most popular; six."""
    f = credits(spark, sf).select(F.col("src").alias("person"), F.col("dst").alias("id")).distinct().join(films(spark, sf), "id")
    return etl.quota_selection(f, "person", [F.desc("awarded"), F.desc("popularity"), F.col("seq")], 6).select("person", "id", "pos")


@query("select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as value from events group by event_type")
def run_log_counts(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


