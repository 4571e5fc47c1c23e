"""Queries of the seed sources, the gate and the order of precedence, over one question of each customer, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import resolve, seeds
from wayfind.operators.shared import stored
from wayfind.plans.cinema import CINEMA, SYLLABLES, asks, parts, shows, stars
from wayfind.plans.queries import query, route_sql


def listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def kept_sql(name: str, hits: str) -> str:
    """hits (qid, id, label, popularity, seq): each id's longest label, without those that an earlier one contains."""
    return f""",
{name}best as (select * from (select *, row_number() over (partition by qid, id order by length(replace(label, ' ', '')) desc, label) as nth from ({hits})) where nth = 1),
{name}ranked as (select *, row_number() over (partition by qid order by length(replace(label, ' ', '')) desc, popularity desc, seq) as r from {name}best),
{name} as (select qid, id, label, popularity, seq, row_number() over (partition by qid order by r) as rank from {name}ranked a
  where not exists (select 1 from {name}ranked b where b.qid = a.qid and b.r < a.r and contains(replace(lower(b.label), ' ', ''), replace(lower(a.label), ' ', ''))))"""


ENDS = "[''] || " + listed(text.PARTICLES)
SAID = (
    CINEMA
    + f""",
toks as (select qid, list_filter(list_transform(regexp_split_to_array(trim(lower(question)), '\\s+'), lambda t: regexp_replace(t, '^[^0-9a-zA-Z가-힣]+', '')), lambda t: t <> '') as ts from asks),
suffixes as (select qid, array_to_string(list_slice(ts, i, len(ts)), '') as s from (select qid, ts, unnest(range(1, len(ts) + 1)) as i from toks)),
bare as (select qid, unnest(list_transform(regexp_split_to_array(question, '\\s+'), lambda t: lower(regexp_replace(t, '[^0-9A-Za-z가-힣]+', '', 'g')))) as t from asks),
whole as (select distinct qid, left(t, length(t) - length(e)) as key from (select qid, t, unnest({ENDS}) as e from bare) where suffix(t, e) and length(t) - length(e) >= 2),
plabels as (select id, label, popularity, seq from (select id, unnest([name] || aliases) as label, popularity, seq from stars) where length(label) >= 2 and label not in ({", ".join("'" + w + "'" for w in text.NOT_A_CHARACTER)})),
pkeys as (select *, replace(lower(label), ' ', '') as key from plabels),
phits as (select distinct qid, id, label, popularity, seq from (select s.qid, k.* from suffixes s join pkeys k on length(k.key) > 2 and starts_with(s.s, k.key) union all select w.qid, k.* from whole w join pkeys k on length(k.key) = 2 and k.key = w.key))"""
    + kept_sql("pin", "select * from phits")
    + """,
tkeys as (select id, title, popularity, seq, replace(lower(title), ' ', '') as key, trim(regexp_split_to_array(title, '[:：]| - ')[1]) as head from shows),
inside as (select a.qid, t.id from asks a join (select distinct title from tkeys) b on contains(a.question, '《' || b.title || '》') or contains(a.question, '〈' || b.title || '〉') or contains(a.question, '「' || b.title || '」') or contains(a.question, '『' || b.title || '』')
    or contains(a.question, '“' || b.title || '”') or contains(a.question, '‘' || b.title || '’') or contains(a.question, '"' || b.title || '"') or contains(a.question, '''' || b.title || '''') join tkeys t on t.title = b.title),
prefixed as (select distinct s.qid, t.id, t.title as label, t.popularity, t.seq, t.key from suffixes s join tkeys t on length(t.title) >= 2 and length(t.key) >= 2 and starts_with(s.s, t.key)),
thits as (
  select qid, id, label, popularity, seq from prefixed where length(key) > 2
  union select w.qid, t.id, t.title, t.popularity, t.seq from whole w join tkeys t on length(t.title) >= 2 and length(t.key) = 2 and t.key = w.key
  union select i.qid, t.id, t.title, t.popularity, t.seq from inside i join tkeys t using (id) where length(t.title) < 2
  union select w.qid, t.id, t.head, t.popularity, t.seq from whole w join tkeys t on length(t.head) >= 2 and length(t.head) < length(t.title) and replace(lower(t.head), ' ', '') = w.key)"""
    + kept_sql("tin", "select * from thits")
)


@query(SAID + " select qid, id, label, rank from pin")
def people_by_alias(spark, sf) -> DataFrame:
    """Names and aliases; those of two characters as whole words only; common words are none."""
    return resolve.people_in(asks(spark, sf), stars(spark, sf)).select("qid", "id", "label", "rank")


@query(SAID + " select qid, id, label, rank from tin")
def titles_by_shape(spark, sf) -> DataFrame:
    """Titles at a token, of one character in brackets, or by what stands before a subtitle."""
    return resolve.titles_in(asks(spark, sf), shows(spark, sf)).select("qid", "id", "label", "rank")


@query(SAID + f" select a.qid, count(w.key) as n_common from asks a left join (select qid, key from whole where list_contains({listed(text.NOT_A_CHARACTER)}, key)) w using (qid) group by a.qid")
def common_words_said(spark, sf) -> DataFrame:
    """How many words that are no names a question says as whole words."""
    return asks(spark, sf).select("qid", F.size(F.array_intersect(text.whole_keys(F.col("question")), F.array(*map(F.lit, text.NOT_A_CHARACTER)))).cast("long").alias("n_common"))


def named_people(spark, sf) -> DataFrame:
    return stored(spark, lambda: resolve.people_in(asks(spark, sf), stars(spark, sf)), "named_people", sf)


def named_titles(spark, sf) -> DataFrame:
    return stored(spark, lambda: resolve.titles_in(asks(spark, sf), shows(spark, sf)), "named_titles", sf)


S_TITLES = ", s_titles as (select qid, id, row_number() over (partition by qid order by length(label) desc, popularity desc, seq) as pos from (select qid, id, label, popularity, seq from prefixed union select i.qid, t.id, t.title, t.popularity, t.seq from inside i join tkeys t using (id)))"


@query(SAID + S_TITLES + " select qid, pos, id from s_titles where pos <= 3")
def seeds_title(spark, sf) -> DataFrame:
    return seeds.from_titles(asks(spark, sf), shows(spark, sf))


S_PERSON = ", s_person as (select p.qid, f.id, row_number() over (partition by p.qid order by f.popularity desc, c.s, c.d, c.kind) as pos from pin p join credits c on c.src = p.id join shows f on f.id = c.dst where p.rank = 1)"


@query(SAID + S_PERSON + " select qid, pos, id from s_person where pos <= 4")
def seeds_person(spark, sf) -> DataFrame:
    """Of the first person; a film counts once for each kind of credit."""
    return seeds.from_person(named_people(spark, sf), parts(spark, sf), shows(spark, sf))


S_INTER = """, pn as (select qid, count(*) as n from pin where rank <= 3 group by qid having count(*) > 1),
s_inter as (select x.qid, f.id, row_number() over (partition by x.qid order by f.popularity desc, f.seq) as pos
  from (select p.qid, c.dst, n from pin p join pn using (qid) join (select distinct src, dst from credits) c on c.src = p.id where p.rank <= 3 group by p.qid, c.dst, n having count(*) = n) x join shows f on f.id = x.dst)"""


@query(SAID + S_INTER + " select qid, pos, id from s_inter where pos <= 5")
def seeds_people_intersection(spark, sf) -> DataFrame:
    return resolve.people_intersection(named_people(spark, sf), parts(spark, sf), shows(spark, sf)).select("qid", "pos", "id")


S_GENRE = """, gorder as (select genre, min((seq, p)) as nth from (select seq, unnest(genres) as genre, unnest(range(len(genres))) as p from shows) group by genre),
gindex as (select genre, id, ko, row_number() over (partition by genre order by ko desc, nth) as place from (select g.genre, s.id, s.ko, row_number() over (partition by g.genre, s.ko order by s.popularity desc, s.seq) as nth from (select unnest(genres) as genre, id from shows) g join shows s using (id)) where nth <= case when ko then 30 else 15 end),
gask as (select qid, regexp_matches(question, '한국|국내') as home, (select arg_min(genre, nth) from gorder where contains(lower(replace(question, ' ', '')), lower(replace(genre, ' ', '')))) as genre from asks),
s_genre as (select qid, id, row_number() over (partition by qid order by place) as pos from (select q.qid, q.home, i.*, bool_or(i.ko) over (partition by q.qid) as any_ko from gask q join gindex i using (genre)) where not home or not any_ko or ko)"""


@query(SAID + S_GENRE + " select qid, pos, id from s_genre where pos <= 3")
def seeds_genre(spark, sf) -> DataFrame:
    return seeds.from_genre(asks(spark, sf), shows(spark, sf))


def tokens_sql(column: str) -> str:
    """Runs of Latin letters and digits; pairs of syllables of Hangul runs."""
    return f"flatten(list_transform(regexp_extract_all({column}, '[0-9A-Za-z]+|[가-힣]+'), lambda r: case when regexp_matches(r, '^[가-힣]') then list_transform(range(1, greatest(length(r), 2)), lambda i: substr(r, i, 2)) else [lower(r)] end))"


S_KEYS = f""", lean as (select qid, case when length(regexp_replace(l, '[^가-힣0-9A-Za-z]', '', 'g')) >= 2 then l else question end as q from (select qid, question, trim(regexp_replace(regexp_replace(question, '{text.QUERY_FILLER}', ' ', 'g'), '\\s+', ' ', 'g')) as l from asks)),
kdocs as (select seq, {tokens_sql("title || ' ' || original_title")} as t3, {tokens_sql("overview || ' ' || genres[1] || ' ' || genres[2]")} as t1 from shows),
ktoks as (select seq, unnest(t3 || t3 || t3 || t1) as tok from kdocs),
ktf as (select seq, tok, count(*) as tf from ktoks group by seq, tok), klen as (select seq, 3 * len(t3) + len(t1) as len from kdocs), kdf as (select tok, count(*) as df from ktf group by tok),
kt as (select count(*) as n, avg(len) as avg_len from klen),
kq as (select qid, tok, count(*) as times from (select qid, unnest({tokens_sql("q")}) as tok from lean) group by 1, 2),
kscore as (select qid, seq, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score from kq join ktf using (tok) join kdf using (tok) join klen using (seq), kt group by qid, seq),
s_keys as (select qid, id, row_number() over (partition by qid order by score desc, seq) as pos from kscore join shows using (seq) where score > 0)"""


@query(SAID + S_KEYS + " select qid, pos, id from s_keys where pos <= 3")
def seeds_keywords(spark, sf) -> DataFrame:
    """BM25 on titles, overviews and genres, of the question without the phrases around it."""
    return seeds.from_keywords(asks(spark, sf), shows(spark, sf))


AWARDED = f""", anames as (select qid, list_filter({listed(seeds.AWARD_NAMES)}, lambda n: contains(lower(regexp_replace(question, '\\s+', '', 'g')), n)) as names, question from asks),
s_paward as (select qid, id, row_number() over (partition by qid order by place) as pos from (
  select q.qid, f.id, min((p.rank, a.i)) as place from anames q join pin p using (qid) join (select id, unnest(awards) as a, unnest(range(len(awards))) as i from stars) a on a.id = p.id join shows f on cast(f.tmdb_id as varchar) = a.a.for_tmdb
  where len(q.names) > 0 and len(list_filter(q.names, lambda n: contains(replace(a.a.award, ' ', ''), n))) > 0 group by q.qid, f.id)),
aways as (select distinct names, regexp_matches(replace(question, ' ', ''), '최근|요즘|올해|근래') as recent from anames where len(names) > 0 or (regexp_matches(question, '수상|상을\\s*받|상\\s*받|영화제') and not (contains(question, '영화제목')))),
aranked as (select names, recent, id, row_number() over (partition by names, recent order by case when recent then -latest else 0 end, popularity desc, seq) as pos from (
  select w.*, f.id, f.popularity, f.seq, list_max(list_transform(f.awards, lambda a: a.year)) as latest from aways w join shows f on len(f.awards) > 0 and (len(w.names) = 0 or len(list_filter(f.awards, lambda a: len(list_filter(w.names, lambda n: contains(replace(a.award, ' ', ''), n))) > 0)) > 0))),
s_award as (select q.qid, r.id, r.pos from anames q join aranked r on r.names = q.names and r.recent = regexp_matches(replace(question, ' ', ''), '최근|요즘|올해|근래') where r.pos <= 8 and (len(q.names) > 0 or (regexp_matches(question, '수상|상을\\s*받|상\\s*받|영화제') and not contains(question, '영화제목'))))"""


@query(SAID + AWARDED + " select qid, pos, id from s_paward where pos <= 4")
def seeds_person_award(spark, sf) -> DataFrame:
    q = asks(spark, sf)
    return seeds.from_person_award(q, named_people(spark, sf), stars(spark, sf), shows(spark, sf))


@query(SAID + AWARDED + " select qid, pos, id from s_award")
def seeds_award(spark, sf) -> DataFrame:
    return seeds.from_award(asks(spark, sf), shows(spark, sf))


#: A name of two syllables, as it is compared: voiced and unvoiced sounds alike, doubled letters as one.
SOUNDS = ["ga", "na", "da", "ra", "ma", "ba", "sa", "a", "ja", "ja", "ga", "da", "ba", "a"]
ROLES = f""", words as (select qid, unnest(list_transform(regexp_split_to_array(question, '\\s+'), lambda t: regexp_extract(t, '[가-힣]{{2,7}}'))) as w from asks),
named as (select * from words where w <> '' and not (length(w) >= 3 and regexp_matches(w, '({"|".join(text.VERB_TAILS)})$'))),
cands as (select distinct qid, c from (select qid, unnest([w, left(w, length(w) - 1), left(w, length(w) - 2)]) as c from named) where length(c) >= 2 and c not in ({", ".join("'" + w + "'" for w in text.NOT_A_CHARACTER)})),
spelt as (select qid, c, regexp_replace(list_extract({listed(SOUNDS)}, i) || list_extract({listed(SOUNDS)}, j), 'a+', 'a', 'g') as key from (select qid, c, cast(list_position({listed(SYLLABLES)}, left(c, 1)) as int) as i, cast(list_position({listed(SYLLABLES)}, right(c, 1)) as int) as j from cands where length(c) = 2) where i > 0 and j > 0),
rolekey as (select src, dst, s, d, regexp_replace(list_extract({listed(SOUNDS)}, cast(ri + 1 as int)) || list_extract({listed(SOUNDS)}, cast(rj + 1 as int)), 'a+', 'a', 'g') as key from parts where as_role is not null),
played as (select qid, c, dst, src, s, d from spelt join rolekey using (key) where length(key) >= 3)"""
S_CHARS = ROLES + """, scoped as (select qid, dst as id, row_number() over (partition by qid order by min((-length(c), rank, s))) as pos from played p join tin t using (qid) where t.id = p.dst group by qid, dst),
open as (select * from played where qid in (select qid from asks where regexp_matches(question, '역할?(을|은|는|이|가|의|으로)?($|[\\s?!.,])|연기|분한|맡은|맡았|열연|배역')) and qid not in (select qid from scoped)),
rare as (select qid, c, count(*) as rare from open group by qid, c having count(*) < 4),
anywhere as (select qid, id, row_number() over (partition by qid order by o) as pos from (select o.qid, f.id, min((r.rare, -length(o.c), -f.popularity, f.seq)) as o from open o join rare r using (qid, c) join shows f on f.id = o.dst group by o.qid, f.id)),
s_chars as (select qid, id, pos from scoped where pos <= 3 union all select qid, id, pos from anywhere where pos <= 3)"""


@query(SAID + S_CHARS + " select qid, pos, id from s_chars")
def seeds_character(spark, sf) -> DataFrame:
    """By a role's name in Hangul, which credits have in Roman letters."""
    q, f = asks(spark, sf), shows(spark, sf)
    return seeds.from_character(q, named_titles(spark, sf), f, parts(spark, sf))


S_ACTOR = S_CHARS + f""", bridged as (select qid from asks where regexp_matches(question, '{seeds.ROLE_BRIDGE}')),
begin as (select qid, id from tin join bridged using (qid) where rank <= 2 union all select qid, id from s_chars join bridged using (qid) where pos <= 2 and qid not in (select qid from tin where rank <= 2)),
actors as (select distinct p.qid, p.src from played p join begin b on b.qid = p.qid and b.id = p.dst),
pool0 as (select distinct a.qid, c.dst as id from actors a join credits c on c.src = a.src and c.kind = 'ACTED_IN' where not exists (select 1 from begin b where b.qid = a.qid and b.id = c.dst)),
bydir as (select distinct o.qid, o.id from pool0 o join credits c on c.dst = o.id and c.kind = 'DIRECTED' join pin p on p.qid = o.qid and p.id = c.src),
pool1 as (select * from pool0 where qid not in (select qid from bydir) union all select * from bydir),
bychar as (select distinct o.qid, o.id from pool1 o join played p on p.qid = o.qid and p.dst = o.id join actors a on a.qid = p.qid and a.src = p.src),
fewer as (select o.qid from (select qid, count(*) as n from pool1 group by qid) o join (select qid, count(*) as k from bychar group by qid) b using (qid) where k < n),
pool2 as (select * from pool1 where qid not in (select qid from fewer) union all select * from bychar where qid in (select qid from fewer)),
s_actor as (select p.qid, f.id, row_number() over (partition by p.qid order by f.popularity desc, f.seq) as pos from pool2 p join shows f using (id))"""


@query(SAID + S_ACTOR + " select qid, pos, id from s_actor where pos <= 8")
def seeds_character_actor(spark, sf) -> DataFrame:
    """Other films of who played the role, narrowed by a second condition where one is met."""
    q, f, p = asks(spark, sf), shows(spark, sf), parts(spark, sf)
    titles = named_titles(spark, sf)
    return seeds.from_character_actor(q, named_people(spark, sf), titles, seeds.from_character(q, titles, f, p), f, p)


S_COMMON = """, tnamed as (select qid, key, id, row_number() over (partition by qid order by rank) as part from (select t.qid, k.key, t.id, t.rank, row_number() over (partition by t.qid, k.key order by t.rank) as nth from tin t join tkeys k using (id)) where nth = 1),
tgroups as (select n.qid, n.part, k.id, row_number() over (partition by n.qid, n.part order by k.id <> n.id, k.seq) as nr from tnamed n join tkeys k using (key) where n.part <= 4),
tn as (select qid, max(part) as n from tgroups group by qid having max(part) > 1),
tcommon as (select g.qid, c.src, tn.n from tgroups g join tn using (qid) join credits c on c.dst = g.id group by g.qid, c.src, tn.n having count(distinct g.part) = tn.n),
tpicked as (select * from (select g.*, row_number() over (partition by g.qid, g.part order by exists (select 1 from tcommon c join credits e on e.src = c.src where c.qid = g.qid and e.dst = g.id) desc, nr) as nth from tgroups g join tn using (qid)) where nth = 1),
tacted as (select c.qid, c.src, (select count(distinct p.part) from tpicked p join credits e on e.dst = p.id and e.src = c.src and e.kind = 'ACTED_IN' where p.qid = c.qid) = c.n as acted from tcommon c),
s_people as (select t.qid, t.src as id, t.acted, row_number() over (partition by t.qid order by case when regexp_matches(a.question, '배우|출연|연기') then (not t.acted)::int when regexp_matches(a.question, '감독|연출') then t.acted::int else 0 end, s.popularity desc, s.seq) as pos from tacted t join stars s on s.id = t.src join asks a using (qid)),
s_common as (select qid, id, part as pos from tpicked where qid in (select qid from s_people))"""


@query(SAID + S_COMMON + " select qid, id, acted, pos from s_people where pos <= 5")
def common_people_by_question(spark, sf) -> DataFrame:
    """People of all titles a question names; actors or directors first, as it asks."""
    q, f = asks(spark, sf), shows(spark, sf)
    return resolve.common_people(q, named_titles(spark, sf), f, parts(spark, sf), stars(spark, sf))[0]


ALL = SAID + S_TITLES + S_PERSON + S_INTER + S_GENRE + S_KEYS + AWARDED + S_ACTOR + S_COMMON


def _arrays() -> str:
    tops = {"inter": 5, "common": 4, "actor": 8, "titles": 3, "chars": 3, "award": 8, "paward": 4, "genre": 3}
    picks = [f"coalesce((select list(id order by pos) from s_{n} x where x.qid = a.qid and x.pos <= {k}), []) as {n}" for n, k in tops.items()]
    picks += [f"coalesce((select list(id order by pos) from s_person x where x.qid = a.qid and x.pos <= {k}), []) as person{k}" for k in (4, 12)]
    picks += [f"coalesce((select list(id order by pos) from s_keys x where x.qid = a.qid and x.pos <= {k}), []) as keys{k}" for k in (3, 6)]
    return ", ".join(picks)


#: All sources of a question as lists, its counts, and the gate.
GATED = ALL + f""", src as (
  select a.qid, a.question, {route_sql("a.question")} as route, (select count(*) from pin p where p.qid = a.qid) as n_people, (select count(*) from tin t where t.qid = a.qid) as n_titles, (select count(*) from s_people s where s.qid = a.qid and s.pos <= 5 and s.acted) as n_actors, {_arrays()} from asks a),
gated as (select *, case when len(titles) > 0 then '{seeds.SIGNALS[0]}' when len(person4) > 0 then '{seeds.SIGNALS[1]}' when n_people >= 2 then '{seeds.SIGNALS[2]}' when len(paward) > 0 then '{seeds.SIGNALS[3]}' when len(award) > 0 then '{seeds.SIGNALS[4]}'
  else '{seeds.SIGNALS[5]}' || list_filter({listed(seeds.DOMAIN_WORDS)}, lambda w: contains(lower(regexp_replace(question, '\\s+', '', 'g')), w))[1] end as signal from src)"""
UNION = "list_transform(list_filter(list_zip({0}, range(len({0}))), lambda z: list_position({0}, z[1]) = z[2] + 1), lambda z: z[1])"
FOUND = GATED + f""", found as (select *, case when signal is null then [] when len(inter) > 0 then inter when len(common) > 0 then common when len(actor) > 0 then actor when route in ('filmography', 'cast') and len(person12) > 0 then person12
  when len(titles) > 0 or len(award) > 0 or len(paward) > 0 then {UNION.format("(paward || titles || chars || award || person4 || keys3)")} else {UNION.format("(chars || person4 || genre || keys6)")} end as seeds from gated)"""


def _sources(spark, sf) -> DataFrame:
    return stored(spark, lambda: seeds.sources(asks(spark, sf), shows(spark, sf), stars(spark, sf), parts(spark, sf), named_people(spark, sf), named_titles(spark, sf)), "seed_sources", sf)


@query(GATED + " select qid, signal from gated")
def domain_gate(spark, sf) -> DataFrame:
    """What says that a question is one about films; null if nothing does."""
    return _sources(spark, sf).select("qid", seeds.domain_signal().alias("signal"))


@query(FOUND + " select qid, route, array_to_string(seeds, ' ') as seeds from found")
def find_seeds(spark, sf) -> DataFrame:
    """All nine sources in their order of precedence, behind the gate."""
    return seeds.find_seeds(_sources(spark, sf)).select("qid", "route", F.array_join("seeds", " ").alias("seeds"))


@query(FOUND + """ select qid, case when (regexp_matches(question, '[가-힣]{2,5}(가|이|의)\\s') or regexp_matches(question, '감독|배우')) and route in ('filmography', 'cast') and n_people = 0 and n_titles = 0 then 'unknown_subject'
  when regexp_matches(question, '배우|출연|연기') and n_titles >= 2 and n_actors = 0 then 'no_common_actor' when n_people >= 2 and regexp_matches(question, '함께|같이|모두') and len(inter) = 0 then 'no_common_movie' end as premise from found""")
def premise_check(spark, sf) -> DataFrame:
    """What a question wrongly takes for granted, by what was found for it."""
    return seeds.find_seeds(_sources(spark, sf)).select("qid", seeds.check_premise().alias("premise"))


@query(FOUND + " select route, count(*) as n, count(*) filter (route = 'out_of_scope' or len(seeds) = 0) as refused, round(count(*) filter (route = 'out_of_scope' or len(seeds) = 0) / count(*), 6) as refusal_rate from found group by grouping sets ((route), ())")
def refusal_by_route(spark, sf) -> DataFrame:
    """Refusals of the gate on what was really found: out of scope, or no seeds."""
    from wayfind.operators.route import can_answer

    rows = seeds.find_seeds(_sources(spark, sf)).withColumn("refused", can_answer(F.col("route"), F.size("seeds"), F.size("seeds")).isNotNull())
    return rows.groupingSets([["route"], []], "route").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.round(F.count_if("refused") / F.count("*"), 6).alias("refusal_rate"))


S_BRIDGE = FOUND + """, seeded as (select qid, unnest(seeds) as id, unnest(range(len(seeds))) as pos from found),
anchors as (select qid, coalesce(arg_min(id, pos) filter (named), arg_min(id, pos)) as anchor from (select s.*, exists (select 1 from tin t where t.qid = s.qid and t.id = s.id) as named from seeded s) group by qid),
hops as (select distinct s.qid, a.anchor, s.id as other from seeded s join anchors a using (qid) where s.id <> a.anchor),
shared as (select h.qid, h.anchor, h.other, c.src, arg_max(c.ord, c.kind) as ord, arg_max(c.kind, c.kind) as kind, min((c.s, c.d, c.kind)) as place from hops h join credits c on c.dst = h.other where exists (select 1 from credits e where e.dst = h.anchor and e.src = c.src) group by 1, 2, 3, 4)
select qid, anchor, other, src as person, kind from (
  select s.*, row_number() over (partition by qid, other order by asked desc, case when asked then 0 else ord end, place) as nth from (select h.*, exists (select 1 from pin p where p.qid = h.qid and p.id = h.src) as asked from shared h) s) where nth = 1"""


@query(S_BRIDGE)
def seed_bridges_named(spark, sf) -> DataFrame:
    """How seeds that weren't walked to hang together: by whom the question names, else by who is billed first."""
    rows = seeds.find_seeds(_sources(spark, sf)).select("qid", F.posexplode("seeds").alias("pos", "id"))
    return resolve.seed_bridges(rows, parts(spark, sf), named_titles(spark, sf), named_people(spark, sf))
