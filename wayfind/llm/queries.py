"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import bpe_codec, collocations, decontaminate, embedding_dedup, exact_dedup, language_id, license_scan, line_dedup, minhash_dedup, prefix_trie, substring_dedup, token_count, url_filter
from wayfind.llm.common import cut, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list that is itself drawn from the pages.

    A page is fetched on a day that follows from its id. A page with the junk mark %%%
    lists its host from that day on, one with *** its host's first path segment; either
    is delisted 45 days later, unless listed again that day.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"), F.col("html").contains("%%%").alias("a"), F.col("html").contains("***").alias("b"))
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    marked = pages.where("a or b").select("fetched", F.explode(F.array(F.when(F.col("a"), host), F.when(F.col("b"), F.concat_ws("/", host, F.regexp_extract(path, "^/([^/]+)", 1))))).alias("pattern")).where("pattern is not null").distinct()
    on = marked.select("pattern", F.lit(True).alias("listed"), F.col("fetched").alias("as_of"))
    off = marked.select("pattern", F.lit(False).alias("listed"), F.date_add("fetched", 45).alias("as_of"))
    return url_filter.filter_captures(pages, on.unionByName(off))


OP1_SQL = r"""
with pages2 as (
  select page_id, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
    cast(date '2024-01-01' + cast((page_id * 37) % 366 as int) as date) as fetched
  from pages),
marked as (
  select distinct host as pattern, fetched from pages2 where contains(html, '%%%')
  union
  select distinct host || '/' || regexp_extract(path, '^/([^/]+)', 1), fetched from pages2 where contains(html, '***')),
days as (
  select pattern, as_of, bool_or(listed) as listed
  from (select pattern, fetched as as_of, true as listed from marked union all select pattern, cast(fetched + 45 as date), false from marked)
  group by pattern, as_of),
spans as (
  select pattern, as_of as valid_from, lead(as_of) over (partition by pattern order by as_of) as valid_to, listed from days),
keys as (
  select distinct page_id, pattern from (
    select page_id, array_to_string(list_slice(labels, i, len(labels)), '.') as pattern
    from (select page_id, string_split(host, '.') as labels, unnest(range(1, len(string_split(host, '.')) + 1)) as i from pages2)
    union all
    select page_id, host || '/' || array_to_string(list_slice(segments, 1, i), '/')
    from (select page_id, host, segments, unnest(range(1, len(segments) + 1)) as i
          from (select page_id, host, list_filter(string_split(path, '/'), lambda s: s <> '') as segments from pages2)))),
active as (
  select p.page_id, s.pattern from pages2 p join keys k using (page_id) join spans s on s.pattern = k.pattern
  where s.listed and s.valid_from <= p.fetched and (s.valid_to is null or p.fetched < s.valid_to)),
best as (
  select page_id, count(*) as n_active, (list(pattern order by length(pattern) desc, pattern))[1] as pattern from active group by page_id)
select p.page_id, p.host, p.fetched, coalesce(b.n_active > 0, false) as blocked, coalesce(b.n_active, 0) as n_active, b.pattern
from pages2 p left join best b using (page_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated_runs(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null),
runs as (
  select doc_id, pos, line as a, lead(line) over (partition by doc_id order by pos) as b from lines),
later as (
  select doc_id, pos from (select doc_id, pos, row_number() over (partition by a, b order by doc_id, pos) as nth from runs where b is not null) where nth > 1),
gone as (select doc_id, pos from later union select doc_id, pos + 1 from later),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null) as text
  from lines l left join gone g using (doc_id, pos) group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
  case when d.text is null then null else sha256(coalesce(k.text, '')) end as kept_sha256
from documents d left join kept k using (doc_id)
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with items as (
  select item_id, w, len(w) as n from (
    select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark) where len(w) >= 5),
item_grams as (
  select item_id, n, q, array_to_string(list_slice(w, q + 1, q + 5), ' ') as gram from (select *, unnest(range(n - 4)) as q from items)),
weights as (
  select item_id, n, gram, 1.0 / count(distinct item_id) over (partition by gram) as weight from (select distinct item_id, n, gram from item_grams)),
totals as (select item_id, sum(weight) as total from weights group by item_id),
doc_grams as (
  select doc_id, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') as gram
  from (select doc_id, w, unnest(range(len(w) - 4)) as p
        from (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null))),
hits as (select d.doc_id, d.p, g.item_id, g.n, g.q, g.gram from doc_grams d join item_grams g using (gram)),
starts as (select distinct doc_id, item_id, n, greatest(p - q, 0) as s from hits),
inside as (
  select distinct s.doc_id, s.item_id, s.s, h.gram from starts s join hits h on h.doc_id = s.doc_id and h.item_id = s.item_id and h.p between s.s and s.s + s.n - 5),
scored as (
  select i.doc_id, i.item_id, i.s, round(sum(w.weight) / any_value(t.total), 6) as similarity
  from inside i join weights w using (item_id, gram) join totals t using (item_id) group by i.doc_id, i.item_id, i.s)
select doc_id, item_id, max(similarity) as similarity, cast(arg_max(s, (similarity, -s)) as int) as start_word
from scored where similarity >= 0.8 group by doc_id, item_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"), shingle=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from texts window same as (partition by norm)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select lang, piece, row_number() over () as id from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
words as (select id, lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as w from pieces),
counts as (
  select lang, k, phrase, count(*) as f from (
    select lang, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as pos from words, (select unnest(range(1, 6)) as k) where len(w) >= k))
  group by lang, k, phrase),
totals as (select lang, cast(sum(f) as hugeint) as n from counts where k = 1 group by lang),
often as (select * from counts where f >= 100),
cuts as (
  select lang, k, phrase, f, c, array_to_string(list_slice(w, 1, c), ' ') as lft, array_to_string(list_slice(w, c + 1, k), ' ') as rgt
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as c from often where k > 1)),
scores as (
  select c.lang, c.k, c.phrase, c.f as a, c.c, x.f as l, y.f as r, cast(t.n as bigint) as n,
    cast((cast(1000 as hugeint) * c.f * t.n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join often x on x.lang = c.lang and x.phrase = c.lft join often y on y.lang = c.lang and y.phrase = c.rgt join totals t on t.lang = c.lang),
worst as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_phrases as (
  select distinct lang, array_to_string(list_slice(w, pos, pos + m - 1), ' ') as phrase, f
  from (select lang, w, f, m, unnest(range(1, k - m + 2)) as pos from (select lang, f, k, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from often where k > 2))),
kept as (
  select * from worst w where not exists (select 1 from inner_phrases i where i.lang = w.lang and i.phrase = w.phrase and 100 * i.f >= 100 * w.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, rebuilt on an opening that a hundred of them share in part."""
    turns = cut(prefix_trie.numbered(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(*prefix_trie.share_openings(turns))


OP13_SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as place
  from conversations where conv_id is not null),
ids as (
  select conv_id, conv_id - conv_id % 100 as donor,
    -- CRC-32 of the decimal number, bit by bit
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, nothing: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 6 as h
  from (select distinct conv_id from turns)),
rebuilt as (
  select i.conv_id, t.role, t.text, t.place as p, 0 as own from ids i join turns t on t.conv_id = i.donor and t.place <= i.h
  union all
  select i.conv_id, t.role, t.text, t.place, 1 from ids i join turns t on t.conv_id = i.conv_id and t.place > i.h),
placed as (
  select conv_id, row_number() over (partition by conv_id order by own, p) as depth, length(text) as chars, to_json([role, text]) as turn from rebuilt),
paths as (
  select conv_id, depth, chars, string_agg(turn, chr(10)) over (partition by conv_id order by depth) as node,
    depth = max(depth) over (partition by conv_id) as ends
  from placed
  union all
  select i.conv_id, 0, 0, '', not exists (select 1 from placed p where p.conv_id = i.conv_id) from ids i),
steps as (select *, lag(node) over (partition by conv_id order by depth) as parent from paths),
nodes as (
  select node, any_value(depth) as depth, any_value(chars) as chars, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from steps group by node),
children as (select parent as node, count(*) as n_children from nodes where depth > 0 group by parent),
up as (select distinct s.node as below, t.node from steps s join steps t on t.conv_id = s.conv_id and t.depth <= s.depth),
totals as (
  select u.node, count(*) filter (where c.n_children is null) as n_leaves, cast(sum((n.n_convs - 1) * n.chars) as bigint) as saved_tokens
  from up u join nodes n on n.node = u.below left join children c on c.node = u.below group by u.node)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
from nodes n left join children c using (node) join totals t using (node) left join nodes p on p.node = n.parent
"""


OPERATORS = (op1_url_filter, op2_line_dedup, op3_language_id, op4_decontaminate, op5_token_count, op6_bpe_codec, op7_license_scan, op8_minhash_near_dedup, op9_substring_dedup, op10_embedding_near_dedup, op11_exact_dedup, op12_collocations, op13_prefix_trie)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_decontaminate": OP4_SQL, "op11_exact_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL}
