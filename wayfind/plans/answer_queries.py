"""Queries of what answers show and of how they are graded, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import answer, etl, evaluate, route, seeds, traverse
from wayfind.operators.shared import stored
from wayfind.plans.cinema import CINEMA, asks, parts, shows, stars
from wayfind.plans.queries import corpus, query
from wayfind.plans.seed_queries import FOUND, ROLES, SAID, _sources, listed, named_people, named_titles
from wayfind.plans.tables import read

ROLE_SQL = "case c.kind when 'DIRECTED' then '감독' when 'WROTE' then '각본' else '출연' end"
BILLED = "row_number() over (partition by dst order by case kind when 'DIRECTED' then -2 when 'WROTE' then -1 else ord end, s, d, kind)"


@query(FOUND + f""", cfirst as (select qid, coalesce((select id from tin t where t.qid = f.qid and t.rank = 1), seeds[1]) as id from found f where route = 'cast'),
csame as (select f.qid, s.id, row_number() over (partition by f.qid order by s.ko desc, s.vote_count desc, s.seq) as at_, count(*) over (partition by f.qid) as n0 from cfirst f join shows a on a.id = f.id join shows s on s.title = a.title),
ctop as (select qid, id, at_, least(n0, 3) as n from csame where at_ <= 3),
billed as (select *, {BILLED} as pos from parts)
select t.qid, t.at_ as "at", c.pos, c.src as id, s.name, c.as_role, {ROLE_SQL} as role, case when n > 1 then t.id end as movie from ctop t join billed c on c.dst = t.id join stars s on s.id = c.src where c.pos <= case when n > 1 then 12 else 25 end""")
def cast_lists(spark, sf) -> DataFrame:
    """Who is in the film that a question asks about; all films of the title, if it has several."""
    rows = seeds.find_seeds(_sources(spark, sf)).where("route = 'cast'")
    return answer.cast_list(rows, named_titles(spark, sf), shows(spark, sf), parts(spark, sf), stars(spark, sf))


CHAR_SQL = SAID + ROLES.replace("words as (select qid, unnest(list_transform(regexp_split_to_array(question, '\\s+'), lambda t: regexp_extract(t, '[가-힣]{2,7}'))) as w from asks)", "words as (select qid, '' as w from asks)") + f""",
said as (select distinct qid, c from (select qid, unnest([w, left(w, length(w) - 1)]) as c from (select qid, unnest(regexp_extract_all(question, '[가-힣]{{2,5}}')) as w from asks)) where length(c) = 2),
saidkey as (select qid, c, regexp_replace(list_extract(['ga','na','da','ra','ma','ba','sa','a','ja','ja','ga','da','ba','a'], i) || list_extract(['ga','na','da','ra','ma','ba','sa','a','ja','ja','ga','da','ba','a'], j), 'a+', 'a', 'g') as key
  from (select qid, c, cast(list_position(['가','나','다','라','마','바','사','아','자','차','카','타','파','하'], left(c, 1)) as int) as i, cast(list_position(['가','나','다','라','마','바','사','아','자','차','카','타','파','하'], right(c, 1)) as int) as j from said) where i > 0 and j > 0)
"""


@query(CHAR_SQL + """, met as (select k.qid, t.rank, p.s, p.d, p.src, p.dst, x.as_role from saidkey k join rolekey p using (key) join tin t on t.qid = k.qid and t.id = p.dst join parts x on x.src = p.src and x.dst = p.dst and x.kind = 'ACTED_IN' where length(k.key) >= 3),
one as (select qid, s.name as person, f.title as movie, min((rank, m.s, m.d)) as first, arg_max(as_role, (rank, m.s, m.d)) as as_role from met m join stars s on s.id = m.src join shows f on f.id = m.dst group by 1, 2, 3)
select qid, pos, person, movie, as_role from (select *, row_number() over (partition by qid order by first) as pos from one) where pos <= 6""")
def characters_named(spark, sf) -> DataFrame:
    """Who played the roles that a question names, in the films that it names."""
    scope = named_titles(spark, sf).select("qid", F.col("rank").alias("at"), "id")
    return answer.characters(asks(spark, sf), scope, parts(spark, sf), stars(spark, sf), shows(spark, sf))


@query(SAID + """, a as (select p.qid, p.rank, s.name as person, unnest(s.awards) as a, unnest(range(len(s.awards))) as i, q.question from pin p join stars s using (id) join asks q using (qid)),
h as (select *, len(list_filter(regexp_extract_all(a.award, '[가-힣]{2,}'), lambda w: contains(replace(question, ' ', ''), w))) > 0 as hit from a),
o as (select *, row_number() over (partition by qid, rank order by hit desc, a.for_title is null, i) as k from h)
select qid, pos, person, a.award as award, a.year as year, a.for_title as for_title from (select *, row_number() over (partition by qid order by rank, k) as pos from o where k <= 6) where pos <= 8""")
def person_awards_shown(spark, sf) -> DataFrame:
    return answer.person_awards(asks(spark, sf), named_people(spark, sf), stars(spark, sf))


def walked(spark, sf) -> DataFrame:
    """Evidence of all questions from their seeds, each by its route's plan, in one walk."""

    def make():
        begin = seeds.find_seeds(_sources(spark, sf)).where("route <> 'out_of_scope'").select("qid", F.col("route").alias("plan"), F.posexplode("seeds").alias("pos", "id"))
        return traverse.evidence(traverse.expand_by_plan(begin, shows(spark, sf), parts(spark, sf), stars(spark, sf), route.PLANS))

    return stored(spark, make, "walked", sf)


@query(FOUND + f""", cseeds as (select qid, unnest(seeds) as id, unnest(range(len(seeds))) as pos from found where route in ('filmography', 'cast')),
cone as (select qid, id, row_number() over (partition by qid order by min(pos)) - 1 as pos from cseeds group by qid, id),
cbilled as (select c.dst, string_agg({ROLE_SQL} || ' ' || s.name, '·' order by c.pos) as credits from (select *, {BILLED} as pos from parts) c join stars s on s.id = c.src where c.pos <= 5 group by c.dst)
select qid, pos, f.id, f.title, f.year, case when release_date is not null then f.year || '년 ' || (f.seq % 12 + 1) || '월 ' || (f.seq % 28 + 1) || '일 개봉' else f.year || '년 개봉' end as released, f.ko as korean, coalesce(b.credits, '') as credits, true as is_seed, '' as steps
from cone join shows f using (id) left join cbilled b on b.dst = f.id""")
def evidence_cards(spark, sf) -> DataFrame:
    """What the cards of questions for a person's or a film's credits show: these aren't walked, so that all are seeds."""
    rows = seeds.find_seeds(_sources(spark, sf)).where("route in ('filmography', 'cast')").select("qid")
    found = walked(spark, sf).join(rows, "qid", "left_semi")
    out = answer.cards(found, shows(spark, sf), parts(spark, sf), stars(spark, sf))
    return out.withColumn("credits", F.array_join("credits", "·")).withColumn("steps", F.array_join("steps", " "))


TERMS_SQL = CINEMA + f""", tq as (select qid, list_slice(list_distinct_ordered, 1, 5) as terms from (
  select qid, list_transform(list_filter(list_zip(ws, range(len(ws))), lambda z: list_position(ws, z[1]) = z[2] + 1), lambda z: z[1]) as list_distinct_ordered from (
    select qid, list_filter(list_transform(regexp_extract_all(question, '[가-힣]{{2,}}'), lambda w: regexp_replace(w, '{text.TERM_ENDINGS}', '')), lambda w: length(w) >= 2 and not list_contains({listed(text.TERM_NOISE)}, w)) as ws from asks)))"""


@query(TERMS_SQL + " select qid, array_to_string(terms, ' ') as terms from tq")
def question_terms(spark, sf) -> DataFrame:
    """The conditions in a question, without what only frames it."""
    return asks(spark, sf).select("qid", F.array_join(text.query_terms(F.col("question")), " ").alias("terms"))


LAST = "case when contains(head, '{0}') then length(head) - position(reverse('{0}') in reverse(head)) - 1 else -1 end"


@query(f"""with b as (select doc_id, case doc_id % 3 when 1 then replace(text, '. ', '다.') when 2 then replace(text, '.', '다' || chr(10)) else text end as body from documents), h as (select *, left(body, 460) as head from b),
e as (select doc_id, head, greatest({LAST.format(". ")}, {LAST.format("다.")}, {LAST.format("다' || chr(10) || '")}) as end_ from h)
select doc_id, sha256(trim(regexp_replace(case when end_ > 120 then left(head, end_ + 2) else head end, '\\s+', ' ', 'g'))) as sha256 from e""")
def document_summaries(spark, sf) -> DataFrame:
    """The first sentences of each document; two in three have Korean sentence ends in place of full stops."""
    t = F.col("text")
    body = F.when(F.col("doc_id") % 3 == 1, F.replace(t, F.lit(". "), F.lit("다."))).when(F.col("doc_id") % 3 == 2, F.replace(t, F.lit("."), F.lit("다\n"))).otherwise(t)
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.summary(body), 256).alias("sha256"))


# --- grading ---

#: Items from questions: kinds, answers and what was said follow from the key.
KINDS = ["release", "cast", "intersect-movie", "verify-claim", "out_of_scope", "character"]
SAYS = ["그 영화는 《{t}》 입니다", "확인되지 않습니다", "1995년에 개봉했습니다", "아닙니다", "{p} 입니다"]
ITEMS_SQL = CINEMA + f""", g as (select a.qid as id, list_extract({listed(KINDS)}, cast(a.qid % 6 + 1 as int)) as kind, '《' || f.title || '》 (' || f.year || ')' as answer, case when a.qid % 4 <> 0 then s.name end as need_person, case when a.qid % 3 = 0 then [f.title] else [] end as need_movies, a.qid % 2 = 0 as claim_true,
  case when a.qid % 7 = 6 then null else replace(replace(list_extract({listed(SAYS)}, cast(a.qid % 5 + 1 as int)), '{{t}}', f.title), '{{p}}', s.name) end as said, case when a.qid % 5 < 3 then 'tuned' else 'holdout' end as split
  from asks a join shows f on f.seq = a.qid join stars s on s.seq = a.qid),
w as (select *, trim(regexp_replace(answer, '[《》'']', '', 'g')) as clean, regexp_extract(answer, '\\d{{4}}') as yr from g),
x as (select *, list_distinct(list_filter(case when kind = 'release' or (kind = 'verify-claim' and need_person is null) then [case when yr <> '' then yr else clean end] when kind in ('character', 'cast', 'intersect-person') then [need_person, clean] else need_movies || [clean] end, lambda v: v is not null and v <> '')) as wanted from w),
fl as (select *, regexp_replace(said, '[\\s《》「」＜＞<>''"]', '', 'g') as f from x),
graded as (select *, case when kind in ('out_of_scope', 'no-answer') then case when said is null or regexp_matches(said, '{evaluate.REFUSAL}') then 'right' else 'wrong' end
  when kind = 'verify-claim' and not claim_true and said is null then 'right' when said is null then 'wrong'
  when kind = 'verify-claim' and need_person is not null then case when claim_true <> regexp_matches(said, '{evaluate.DENIAL}') then 'right' else 'wrong' end
  when len(wanted) = 0 then 'excluded' when len(list_filter(wanted, lambda v: contains(f, regexp_replace(v, '[\\s《》「」＜＞<>''"]', '', 'g')))) > 0 then 'right' else 'wrong' end as verdict from fl)"""


def graded(spark, sf) -> DataFrame:
    k = F.col("qid")
    rows = asks(spark, sf).join(shows(spark, sf).select("seq", "title", "year"), F.col("seq") == k).drop("seq").join(stars(spark, sf).select("seq", "name"), F.col("seq") == k)
    pick = lambda options, at: F.element_at(F.array(*map(F.lit, options)), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))
    said = F.when(k % 7 != 6, F.replace(F.replace(pick(SAYS, k), F.lit("{t}"), F.col("title")), F.lit("{p}"), F.col("name")))
    none = F.array().cast("array<string>")
    rows = rows.select(k.alias("id"), pick(KINDS, k).alias("kind"), F.concat(F.lit("《"), "title", F.lit("》 ("), "year", F.lit(")")).alias("answer"), F.when(k % 4 != 0, F.col("name")).alias("need_person"), F.when(k % 3 == 0, F.array("title")).otherwise(none).alias("need_movies"), (k % 2 == 0).alias("claim_true"), said.alias("said"), F.when(k % 5 < 3, "tuned").otherwise("holdout").alias("split"))
    wanted = evaluate.expected(F.col("kind"), F.col("answer"), F.col("need_person"), F.col("need_movies"), none)
    return rows.withColumn("wanted", wanted).withColumn("verdict", evaluate.grade(F.col("kind"), F.col("said"), F.col("claim_true"), F.col("need_person"), F.col("wanted")))


@query(ITEMS_SQL + " select id, kind, len(wanted) as n_wanted, verdict from graded")
def answer_grades(spark, sf) -> DataFrame:
    return graded(spark, sf).select("id", "kind", F.size("wanted").cast("long").alias("n_wanted"), "verdict")


@query(ITEMS_SQL + " select kind, count(*) as n, count(*) filter (verdict = 'right') as k, round(count(*) filter (verdict = 'right') / count(*), 6) as rate from graded group by kind")
def accuracy_by_kind(spark, sf) -> DataFrame:
    return evaluate.rates(graded(spark, sf).withColumn("ok", F.col("verdict") == "right"), "kind", "ok")


@query(ITEMS_SQL + ", r as (select count(*) filter (split = 'tuned' and verdict = 'right') / count(*) filter (split = 'tuned') as a, count(*) filter (split = 'holdout' and verdict = 'right') / count(*) filter (split = 'holdout') as b from graded) select round(a, 6) as tuned, round(b, 6) as holdout, round(a - b, 6) as gap from r")
def overfit_gap(spark, sf) -> DataFrame:
    return evaluate.overfit_gap(graded(spark, sf).withColumn("ok", F.col("verdict") == "right"), "split", "ok")


@query("with b as (select doc_id, text || chr(10) || '    감독 ' || source as block from documents where text is not null) select cast(round(avg(length(block))) as bigint) as mean, max(length(block)) as largest, cast(round(100 * sum(length('    감독 ' || (select source from documents d where d.doc_id = b.doc_id)) + 1) / sum(length(block))) as bigint) as credit_percent from b")
def evidence_sizes(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").where("text is not null")
    return evaluate.evidence_sizes(d.select(F.concat("text", F.lit("\n    감독 "), "source").alias("block")))


@query("with d as (select doc_id, source, lang, text from documents), want as (select b.item_id as id, b.item_id % 10 as k, ['src' || b.item_id % 3, case when b.item_id % 4 = 0 then 'nowhere' else 'src1' end] as expected from benchmark b) select id, len(list_filter(expected, lambda e: not list_contains((select list(distinct source) from d), e))) = 0 as covered from want".replace("lambda e: not list_contains((select list(distinct source) from d), e)", "lambda e: not list_contains(s, e)").replace("from want", "from want, (select list(distinct source) as s from d)"))
def expected_sources(spark, sf) -> DataFrame:
    """Whether all documents that an item expects are among the sources."""
    sources = read(spark, sf, "documents").agg(F.collect_set("source").alias("s"))  # some tens of sources in one row
    i = F.col("item_id")
    want = F.array(F.concat(F.lit("src"), i % 3), F.when(i % 4 == 0, F.lit("nowhere")).otherwise(F.lit("src1")))
    return read(spark, sf, "benchmark").crossJoin(F.broadcast(sources)).select(i.alias("id"), evaluate.covers(want, F.col("s")).alias("covered"))


GOLD_SQL = """with gold as (select o_orderkey as id, 'c' || o_custkey || ' ─PARTICIPATED_IN─▶ o' || (o_orderkey + case when o_orderkey % 50 = 0 then 1000000000 else 0 end) || case when o_orderkey % 70 = 0 then ' ─INVENTED_BY─▶ o' || o_orderkey else '' end as path, ['c' || o_custkey, case when o_orderkey % 90 = 0 then 'lost' else 'o' || o_orderkey end] as expected from orders),
known as (select 'c' || c_custkey as id from customer union all select 'o' || o_orderkey from orders)
select id, 'node' as error, n as what from (select id, unnest(regexp_split_to_array(path, '\\s*(─[^─]*─▶|◀─[^─]*─)\\s*')) as n from gold) where n not in (select id from known)
union all select id, 'kind', k from (select id, unnest(regexp_extract_all(path, '─([A-Z_]{3,})─', 1)) as k from gold) where k not in ('PARTICIPATED_IN', 'FOUNDED', 'MEMBER_OF', 'LED', 'AFFECTED', 'STUDIED_UNDER')
union all select id, 'document', e from (select id, unnest(expected) as e from gold) where e not in (select id from known)"""


@query(GOLD_SQL)
def golden_integrity(spark, sf) -> DataFrame:
    """Paths and documents of golden items (one for each order) that the graph doesn't have."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("c"), "o_custkey", F.lit(" ─PARTICIPATED_IN─▶ o"), F.when(k % 50 == 0, k + 1000000000).otherwise(k), F.when(k % 70 == 0, F.concat(F.lit(" ─INVENTED_BY─▶ o"), k)).otherwise(""))
    gold = o.select(k.alias("id"), path.alias("path"), F.lit("").alias("quote"), F.array(F.concat(F.lit("c"), "o_custkey"), F.when(k % 90 == 0, F.lit("lost")).otherwise(F.concat(F.lit("o"), k))).alias("expected"))
    known = c.select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(o.select(F.concat(F.lit("o"), k).alias("id")))
    none = corpus(spark, sf).select(F.col("id"), "text").limit(0)
    return evaluate.golden_errors(gold, known, list(etl.SIGNATURES), none, known)


@query("select b.item_id as id from benchmark b where not exists (select 1 from documents d where contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))")
def golden_quotes_missing(spark, sf) -> DataFrame:
    """Quotes of golden items (the benchmark's) that no document holds."""
    gold = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("").alias("path"), F.col("text").alias("quote"), F.array().cast("array<string>").alias("expected"))
    empty = read(spark, sf, "nation").select(F.col("n_name").alias("id"))
    return evaluate.golden_errors(gold, empty, list(etl.SIGNATURES), corpus(spark, sf), empty).where("error = 'quote'").select("id")


# --- follow-ups ---

#: Follow-up questions; one for each person, by the key.
FOLLOWS = ["그중에 최근 한국 영화만 평점 높은 순으로", "그 중 상 받은 것만", "거기서 해외 액션", "그것들 오래된 순", "그중에 아무거나 골라줘", "한국 영화만", "방금 그 목록에서 드라마 최신", "이중 외국 영화 중 별점 좋은"]
BARE = "replace(list_extract([" + ", ".join(f"'{q}'" for q in FOLLOWS) + f"], cast(s.seq % {len(FOLLOWS)} + 1 as int)), ' ', '')"
FOLLOW_SQL = CINEMA + f""", ask as (select s.id as qid, {BARE} as q from stars s),
refs as (select *, len(list_filter({listed([w.replace(" ", "") for w in route.REFERS_BACK])}, lambda w: contains(q, w))) > 0 as refers, list_filter({listed(route.GENRES)}, lambda g: contains(q, g)) as gs,
  {", ".join(f"regexp_matches(q, '{yes}')" + (f" and not regexp_matches(q, '{no}')" if no else "") + f" as f{i}" for i, (_, yes, no) in enumerate(route.FILTERS))} from ask),
fol as (select *, refers and (f0 or f1 or f2 or f3 or f4 or f5 or len(gs) > 0) as ok from refs),
prev as (select src as qid, f.*, row_number() over (partition by src order by popularity desc, seq) as pos from (select distinct src, dst from credits) c join shows f on f.id = c.dst)"""


def follow_ups(spark, sf) -> DataFrame:
    k = F.col("seq")
    q = F.element_at(F.array(*map(F.lit, FOLLOWS)), (F.pmod(k, F.lit(len(FOLLOWS))) + 1).cast("int"))
    ok, filters, gave_up = route.follow_up(F.col("question"), F.lit(True))
    return stars(spark, sf).select(F.col("id").alias("qid"), q.alias("question")).select("qid", ok.alias("ok"), filters.alias("filters"), gave_up.alias("gave_up"))


@query(FOLLOW_SQL + f" select qid, ok, case when refers and not ok then '{route.NO_FILTER}' end as gave_up from fol")
def follow_up_detected(spark, sf) -> DataFrame:
    """Which questions point back at the last answer and say what to keep of it."""
    return follow_ups(spark, sf).select("qid", "ok", "gave_up")


@query(FOLLOW_SQL + """ select p.qid, p.id, row_number() over (partition by p.qid order by case when f5 then -vote_average else 0 end, case when f4 then coalesce(year, 9999) else 0 end, case when f3 then -coalesce(year, 0) else 0 end, pos) as new_pos
from prev p join fol f using (qid) where ok and pos <= 30 and (not f0 or len(awards) > 0) and (not f1 or ko) and (not f2 or not ko) and len(list_filter(gs, lambda g: not list_contains(genres, g))) = 0""")
def follow_up_answers(spark, sf) -> DataFrame:
    """Each person's 30 most popular films, kept and ordered as the person's follow-up says."""
    from wayfind.operators import graph

    f = shows(spark, sf)
    rows = graph.top_films(parts(spark, sf), f, 30).select(F.col("person").alias("qid"), "id", "pos").join(f.select("id", "ko", "year", "genres", F.col("vote_average").alias("rating"), (F.size("awards") > 0).alias("awarded")), "id")
    asked = follow_ups(spark, sf).where("ok")
    return route.apply_filters(rows.join(asked, "qid"), route.GENRES).select("qid", "id", "new_pos")
