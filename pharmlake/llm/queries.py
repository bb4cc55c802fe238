"""Registered queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import (chat_format, conversation_repair, decontamination, fingerprints, language_id, line_dedup, mixing,
               ngram_join, packing, sharding, vector_search, warc, whitening)
from .tables import read

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add(fn) if fn else add


@query(sql=r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 k
  from documents),
w as (select doc_id, k, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) s from l),
c as (select s, len(s) n, min((doc_id, k)) first, row_number() over () id from w where len(s) >= 1 group by s),
f as (select t, count(*) f from (select unnest(s) t from c) group by t),
p as (select id, n, x.t, row_number() over (partition by id order by f.f, x.t) r
  from (select id, n, unnest(s) t from c) x join f on f.t = x.t),
pairs as (select distinct a.id a, b.id b from p a join p b on a.t = b.t and a.id <> b.id and a.n <= b.n and 5 * a.n >= 4 * b.n
  and a.r <= a.n - ceil(0.8 * a.n) + 1 and b.r <= b.n - ceil(0.8 * b.n) + 1),
links as (select a.id a, b.id b, a.first fa, b.first fb, len(list_intersect(a.s, b.s)) o, a.n na, b.n nb
  from pairs join c a on a.id = pairs.a join c b on b.id = pairs.b),
good as (select * from links where 100 * o >= 80 * (na + nb - o)),
hit as (select a id from good where fb < fa union select b from good where fa < fb),
gone as (select w.doc_id, w.k, (w.doc_id, w.k) <> c.first or c.id in (select id from hit) gone
  from w join c on w.s = c.s),
flag as (select w.doc_id, w.k, w.line, coalesce(gone, false) gone from w left join gone g on g.doc_id = w.doc_id and g.k = w.k)
select d.doc_id, case when d.text is not null then coalesce(string_agg(line, chr(10) order by k) filter (not gone), '') end as text,
  coalesce(count(line), 0) n_lines, coalesce(list(k order by k) filter (gone), []) removed_lines
from documents d left join flag on flag.doc_id = d.doc_id group by d.doc_id, d.text""")
def op1_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"), min_words=1)
    return out.select("doc_id", "text", "n_lines", "removed_lines")


@query
def op2_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark, sf_dir):
    out = mixing.schedule(read(spark, sf_dir, "documents"), max_repeats=2.0)
    return out.select("doc_id", "source", "tokens", "weight", "epoch", "block", "slot")


@query
def op4_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op6_scaled_fingerprint(spark, sf_dir):
    out = fingerprints.fingerprints(read(spark, sf_dir, "documents"))
    return out.withColumns({c: fingerprints.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op7_tree_forest_search(spark, sf_dir):
    return vector_search.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(sql=r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end s from words),
classes as (select min(doc_id) c, s, len(s) n from sets where len(s) > 0 group by s),
items as (select c, n, unnest(s) t from classes),
links as (
  select a.c a, b.c b from items a join items b on a.t = b.t and a.c <> b.c
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select c, c r from classes union select l.b, reach.r from reach join links l on l.a = reach.c),
roots as (select c, min(r) r from reach group by c)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(r.r, s.doc_id) component_id
from sets s left join classes k on s.s = k.s left join roots r on r.c = k.c""")
def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(sql="""
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html) payload_bytes, sha256(html) payload_digest,
  min(page_id) over (partition by html) first from p)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first then first end refers_to, true complete
from d""")
def op5_warc(spark, sf_dir):
    return warc.archive(read(spark, sf_dir, "pages"))


@query
def op9_sharding(spark, sf_dir):
    out = sharding.shard(read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


PROBE = r"\### Assistant: </turn> ok"  # the contract's conversation -7


def with_probe(conversations):
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


@query(sql=r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '</part>', '<\/part>'),
    '### ', '#\## ') as esc,
  lag(role) over (partition by conv_id order by turn, role, text) as prev,
  lead(role) over (partition by conv_id order by turn, role, text) as next from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(length(esc) + case when prev is null or prev <> role then 6 + length(role) else 0 end
    + case when next is null or next <> role then 8 else 7 end) as bigint) formatted_chars
from e group by conv_id""")
def op10_chat_formatting(spark, sf_dir):
    return chat_format.digests(chat_format.format_conversations(with_probe(read(spark, sf_dir, "conversations"))))


@query
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query(sql=r"""
with dw as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select coalesce(cast(item_id as varchar), '') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') s
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from iw where len(w) > 0)),
sizes as (select distinct n from windows),
spots as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
found as (select r, i, spots.n, item from spots join windows on spots.n = windows.n and spots.s = windows.s),
hit as (select r, count(distinct k) n_hit from (select r, unnest(range(i, i + n)) k from (select distinct r, i, n from found)) group by r),
named as (select r, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct r, item from found) group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit on hit.r = dw.r left join named on named.r = dw.r""")
def op12_benchmark_decontamination(spark, sf_dir):
    return decontamination.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _repair_sql() -> str:
    """The repair as a recursive query: one best path (cost and audit as one comparable
    string, repaired turns) per place of the pattern, row after row."""
    def step(path, cost, letter, turn=None):
        key = f"lpad(cast(cast({path}.k[1:10] as bigint) + {cost} as varchar), 10, '0') || {path}.k[11:] || '{letter}'"
        return f"{{'k': {key}, 'r': {path}.r" + (f" || chr(10) || {turn}" if turn else "") + "}"

    none = "{'k': '0100000000', 'r': ''}"

    def best(*paths):
        return f"list_min([{', '.join(paths)}])"

    def stays(test, path, cost, letter, turn):
        return f"case when {test} then {step(path, cost, letter, turn)} else {none} end"

    def inserted(source):  # with inserts before the next row
        return (f"select *, {best('m2', step('m3', 5, 'I', chr(39) + 'user:' + chr(39)))} n2, "
                f"{best('s3', step('m2', 5, 'I', chr(39) + 'assistant:' + chr(39)))} n3 from (select *, "
                f"{best('s2', *[step(s, 5, 'I', chr(39) + 'user:' + chr(39)) for s in ('s0', 's1')])} m2, s3 m3 from {source})")

    extra = "case when fault = 'truncated' then 5 else 0 end"
    keep, cost = "role || ':' || text", f"({extra})"

    def to_user(letter, test, c, turn):
        return [stays(f"{test}", p, f"({c} + {cost})", letter, turn) for p in ("s0", "s1", "n3")]

    live = "fault not in ('blank', 'duplicate')"
    return rf"""
with recursive bits as (select range n, range v, 0 k from range(256) union all
  select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc as (select list(v order by n) tbl from bits where k = 8),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') key from conversations),
hashed as (select src.*, xor(list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ord(x) as bigint) for x in string_split(key, '')]),
  lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 h from src, crc),
damaged as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
  case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case when h = 0 then 0 when h = 3 then 2 else 1 end)) from hashed),
numbered as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) tail from damaged),
rows_ as (select *, case when tail = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when right(tail, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
  lag(role) over (partition by conv_id order by i) before from numbered),
paths as (
  select conv_id, cast(0 as bigint) i, {{'k': '0000000000', 'r': ''}} s0, {none} s1, {none} s2, {none} s3 from (select distinct conv_id from rows_)
  union all
  select conv_id, i, {step('s0', 2, 'D')} s0,
    {best(step('s1', 2, 'D'), stays(f"{live} and role[1] = 's'", 's0', cost, 'K', keep))} s1,
    {best(step('n2', 2, 'D'), *to_user('K', f"{live} and role[1] = 'u'", '0', keep), *to_user('R', live, '1', "'user:' || text"))} s2,
    {best(step('n3', 2, 'D'), stays(f"{live} and role[1] = 'a'", 'n2', cost, 'K', keep), stays(live, 'n2', f"(1 + {cost})", 'R', "'assistant:' || text"))} s3
  from ({inserted("(select r.*, s0, s1, s2, s3 from paths p join rows_ r on p.conv_id is not distinct from r.conv_id and r.i = p.i + 1)")})),
ends as (select conv_id, list_min([s0, n3]) e from ({inserted("(select p.* from paths p join (select conv_id c, max(i) m from rows_ group by 1) x on p.conv_id is not distinct from x.c and p.i = x.m)")})),
stats as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank,
  count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
  count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) illegal from rows_ group by conv_id)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(cast(e.k[1:10] as bigint), 0) as cost, coalesce(e.k[11:], '') audit, sha256(coalesce(e.r[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) o left join stats on o.conv_id is not distinct from stats.conv_id
left join ends on o.conv_id is not distinct from ends.conv_id"""


@query(sql=_repair_sql())
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.digests(read(spark, sf_dir, "conversations"))
