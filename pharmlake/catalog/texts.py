"""Queries: text helpers, instruction samples, request prompts, response metrics,
report texts and user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import metrics as M
from ..operators.instruct import request, request_error
from ..oracle_bindings import with_bindings as W
from ..plans.evaluation import response_table
from ..sources import bindings as B
from . import register

def sql_text(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("'", "''") + "'"


USER_SQL = sql_text(f"{V.IM_START}user\n")
TURN_SQL = sql_text(f"\n{V.IM_END}\n{V.IM_START}assistant\n")
DONE_SQL = sql_text(f"\n{V.IM_END}")
MD5 = "cast(cast(('0x' || substr(md5('42:' || {k}), 1, 8)) as bigint) % {n} as int)"


def _sql_fill(template: str, **fields: str) -> str:
    """SQL twin of ``fill``: literal pieces and coalesce(field, 'nan')."""
    import string

    parts = []
    for lit, name, _s, _c in string.Formatter().parse(template):
        if lit:
            parts.append(sql_text(lit))
        if name is not None:
            parts.append(f"coalesce(cast({fields[name]} as varchar), 'nan')")
    return "(" + " || ".join(parts) + ")"


def _sql_pick(templates, key_sql: str, **fields) -> str:
    idx = MD5.format(k=key_sql, n=len(templates))
    whens = " ".join(f"when {i} then {_sql_fill(t, **fields)}" for i, t in enumerate(templates))
    return f"case {idx} {whens} end"


# ---- F1 / L4: template fill --------------------------------------------------
@register("fill_analysis_template", W("compounds") + f"""
select row_id, {_sql_pick(V.ANALYSIS_TEMPLATES, "compound_id", smiles="smiles", name="name")} as instruction from compounds""")
def fill_analysis_template(spark, d):
    from ..operators.splits import pick_index

    c = B.compounds(spark, d)
    opts = [T.fill(t, smiles="smiles", name="name") for t in V.ANALYSIS_TEMPLATES]
    return c.select("row_id", T.pick(opts, pick_index("compound_id", len(opts))).alias("instruction"))


# ---- F2 / F4 / F6 / M18 / M20 on conversations ---------------------------------
@register("text_cases", """
select conv_id, turn, upper(substr(role, 1, 1)) || lower(substr(role, 2)) as role_cap, upper(role) as role_upper,
  length(trim(text, ' \t\n\r')) as stripped_length, lower(text) as lower_text,
  case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as short_text from conversations""")
def text_cases(spark, d):
    c = B.chats(spark, d)
    return c.select("conv_id", "turn", T.capitalise("role").alias("role_cap"), F.upper("role").alias("role_upper"),
                    F.length(T.strip("text")).cast("bigint").alias("stripped_length"),
                    F.lower("text").alias("lower_text"), T.shorten("text", 100).alias("short_text"))


@register("chatml_pairs", f"""
WITH t AS (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as nr,
  lead(text) over (partition by conv_id order by turn) as nt from conversations)
select conv_id, turn, {USER_SQL} || text || case when turn % 2 = 0 then ' ' || role else '' end || {TURN_SQL} || nt || {DONE_SQL} as text
from t where role = 'user' and nr = 'assistant'""")
def chatml_pairs(spark, d):
    from ..operators.history import last_turns

    t = last_turns(B.chats(spark, d), 1).where(F.col("reply").isNotNull())
    inp = F.when(F.col("turn") % 2 == 0, F.lit("user")).otherwise(F.lit(""))
    return t.select("conv_id", "turn", T.chatml("message", inp, "reply").alias("text"))


@register("ensure_chat", f"""
select conv_id, turn, case when contains(text, {sql_text(V.IM_START)}) then text else {USER_SQL} || text || {TURN_SQL} end as prompt from conversations where role = 'user'""")
def ensure_chat(spark, d):
    c = B.chats(spark, d).where(F.col("role") == "user")
    return c.select("conv_id", "turn", T.ensure_chat("text").alias("prompt"))


# ---- M19 / P14: request prompts ---------------------------------------------
def _strip_sql(x):
    return f"trim({x}, ' \t\n\r')"


def _part_sql(prefix, x):
    return f"case when {x} is not null and {x} <> '' then {sql_text(prefix)} || {x} else '' end"


@register("request_prompts", W("compounds") + f"""
, r AS (select row_id, smiles, name, status as problem, case when row_id % 2 = 0 then source end as reason,
  smiles as smiles2, compound_id as name2 from compounds)
select row_id,
  coalesce(case when coalesce({_strip_sql('smiles')} = '', true) then '{V.ERROR_NO_SMILES}' end,
    {sql_text(V.PROMPT_ANALYSIS)} || {_strip_sql('smiles')} || {_part_sql(V.PROMPT_ANALYSIS_NAME, 'name')}) as analysis,
  coalesce(case when coalesce({_strip_sql('smiles')} = '', true) then '{V.ERROR_NO_SMILES}' end,
    {sql_text(V.PROMPT_FAILURE)} || coalesce(name, '') || {sql_text(V.PROMPT_FAILURE_SMILES)} || {_strip_sql('smiles')} ||
    {_part_sql(V.PROMPT_FAILURE_REASON, 'reason')}) as failure,
  coalesce(case when coalesce({_strip_sql('smiles')} = '', true) or coalesce({_strip_sql('smiles2')} = '', true) then '{V.ERROR_NO_PAIR}' end,
    {sql_text(V.PROMPT_COMPARISON)} || {_strip_sql('smiles')} || ' (' || coalesce(name, '') || ')' ||
    {sql_text(V.PROMPT_COMPARISON_SECOND)} || {_strip_sql('smiles2')} || ' (' || coalesce(name2, '') || ')') as comparison,
  coalesce(case when coalesce({_strip_sql('smiles')} = '', true) or coalesce({_strip_sql('problem')} = '', true) then '{V.ERROR_NO_PROBLEM}' end,
    {sql_text(V.PROMPT_SUGGESTION)} || coalesce(problem, '') || {sql_text(V.PROMPT_SUGGESTION_TAIL)} ||
    {_strip_sql('smiles')} || {_part_sql(V.PROMPT_SUGGESTION_NAME, 'name')}) as suggestion
from r""")
def request_prompts(spark, d):
    c = B.compounds(spark, d)
    r = c.select("row_id", "smiles", "name", F.col("status").alias("problem"),
                 F.when(F.col("row_id") % 2 == 0, F.col("source")).alias("reason"),
                 F.col("smiles").alias("smiles2"), F.col("compound_id").alias("name2"))
    return r.select("row_id", *[request(k).alias(k) for k in ("analysis", "failure", "comparison", "suggestion")])


@register("chat_request_errors", f"""
select conv_id, turn, case when coalesce(trim(text, ' \t\n\r') = '', true) then {sql_text(V.ERROR_NO_MESSAGE)} end as error
from conversations where role = 'user'""")
def chat_request_errors(spark, d):
    c = B.chats(spark, d).where(F.col("role") == "user").withColumnRenamed("text", "message")
    return c.select("conv_id", "turn", request_error("chat").alias("error"))


# ---- F13 / F14 / F15 / F16 / F17 / F18 -----------------------------------------
@register("char_token_ids", W("compounds") + """
, t AS (select row_id, string_split(smiles, '') as toks from compounds where smiles is not null and smiles <> '')
, i AS (select row_id, list_transform(toks, lambda x: ascii(x)) as ids from t)
select row_id, len(ids) as n_tokens,
  array_to_string(list_concat(ids[1:512], list_transform(range(greatest(512 - len(ids[1:512]), 0)), lambda x: 0)), ',') as input_ids,
  array_to_string(list_concat(list_transform(range(least(len(ids), 512)), lambda x: 1),
    list_transform(range(512 - least(len(ids), 512)), lambda x: 0)), ',') as attention_mask from i""")
def char_token_ids(spark, d):
    c = B.compounds(spark, d).where(F.col("smiles").isNotNull() & (F.col("smiles") != ""))
    t = c.select("row_id", F.transform(A.char_tokens("smiles"), lambda x: F.ascii(x)).alias("ids"))
    return t.select("row_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.array_join(A.pad_truncate("ids", 512, 0).cast("array<string>"), ",").alias("input_ids"),
                    F.array_join(A.attention_mask("ids", 512).cast("array<string>"), ",").alias("attention_mask"))


@register("fit_prompt_budget", """
select doc_id, len(string_split(text, ' ')) as n_words,
  array_to_string(string_split(text, ' ')[1:1024], ' ') as prompt from documents""")
def fit_prompt_budget(spark, d):
    t = B.tokens(spark, d)
    return t.select("doc_id", F.size(F.split("text", " ")).cast("bigint").alias("n_words"),
                    A.fit_budget("text", 2048, 1024).alias("prompt"))


@register("json_field", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(to_json(struct_pack(k := cast(json_extract_string(props, '$.k') as bigint))) as varchar) as encoded from events""")
def json_field(spark, d):
    e = B.props(spark, d)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("encoded"))


@register("run_names", W("checkpoints") + """
select checkpoint, 'run_' || strftime(saved_at, '%Y%m%d_%H%M%S') as run_name from checkpoints""")
def run_names(spark, d):
    return B.checkpoints(spark, d).select("checkpoint", T.run_name("saved_at").alias("run_name"))


@register("language_lookup", """
select doc_id, coalesce(case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' end, 'other') as language
from documents""")
def language_lookup(spark, d):
    t = B.tokens(spark, d)
    return t.select("doc_id", T.get_or({"en": "English", "fr": "French", "de": "German"}, "lang", "other").alias("language"))


# ---- M22, A4-A6, F3 on responses ----------------------------------------------
RESP_SQL = W("responses") + """
, r AS (select conv_id, turn, prompt_type, response, response_length,
  case when keywords = '' then []::varchar[] else string_split(keywords, ',') end as kws,
  len(string_split(response, ' ')) as tokens_generated from responses),
c AS (select *, list_filter(kws, lambda k: contains(lower(response), lower(k))) as found from r),
cov AS (select *, case when len(kws) = 0 then 1.0 else len(found)::double / len(kws) end as keyword_coverage from c)
"""


@register("keyword_coverage", RESP_SQL + """
select conv_id, turn, array_to_string(found, ',') as keywords_found, round(keyword_coverage, 6) as keyword_coverage,
  contains(lower(response), 'the') as has_the from cov""")
def keyword_coverage(spark, d):
    r = response_table(B.responses(spark, d))
    return r.select("conv_id", "turn", F.array_join("keywords_found", ",").alias("keywords_found"),
                    F.round("keyword_coverage", 6).alias("keyword_coverage"), T.has_word("response", "THE").alias("has_the"))


@register("response_metrics", RESP_SQL + """
select count(*) as total_samples, round(avg(response_length), 6) as avg_response_length,
  round(avg(tokens_generated), 6) as avg_tokens_generated, round(avg(keyword_coverage), 6) as avg_keyword_coverage from cov""")
def response_metrics(spark, d):
    m = M.response_metrics(response_table(B.responses(spark, d)))
    return m.select("total_samples", *[F.round(c, 6).alias(c) for c in ("avg_response_length", "avg_tokens_generated",
                                                                        "avg_keyword_coverage")])


@register("response_success_rate", W("responses") + """
select count(*) as total_samples, count(*) filter (where response_length < 200) as failed_responses,
  round((count(*) - count(*) filter (where response_length < 200))::double / count(*), 6) as success_rate
from responses having count(*) > 0""")
def response_success_rate(spark, d):
    s = M.success_rate(B.responses(spark, d), 200)
    return s.select("total_samples", "failed_responses", F.round("success_rate", 6).alias("success_rate"))


@register("response_per_type", W("responses") + """
select prompt_type, count(*) as count, round(avg(response_length), 6) as avg_length from responses group by prompt_type""")
def response_per_type(spark, d):
    p = M.per_type(B.responses(spark, d))
    return p.select("prompt_type", "count", F.round("avg_length", 6).alias("avg_length"))


TYPES = [f"type{i}" for i in range(5)]


@register("response_per_type_wide", W("responses") + "select " + ", ".join(
    f"count(*) filter (where prompt_type = '{t}') as {t}_count, "
    f"round(avg(response_length) filter (where prompt_type = '{t}'), 6) as {t}_avg_length" for t in TYPES) + " from responses")
def response_per_type_wide(spark, d):
    p = M.per_type_wide(B.responses(spark, d), TYPES)
    out = []
    for t in TYPES:
        out += [F.coalesce(F.col(f"{t}_count"), F.lit(0)).cast("bigint").alias(f"{t}_count"),
                F.round(f"{t}_avg_length", 6).alias(f"{t}_avg_length")]
    return p.select(*out)


def _sql_fixed(col: str, places: int, signed: bool = False) -> str:
    f = f"%{'+' if signed else ''}.{places}f"
    return f"case when {col} is null or isnan({col}) then 'nan' else printf('{f}', round({col}, {places})) end"


@register("fixed_decimal_text", W("compounds") + f"""
select row_id, {_sql_fixed('molecular_weight', 1)} as mw_text, {_sql_fixed('alogp', 2)} as logp_text,
  {_sql_fixed('alogp', 1, True)} as logp_signed, {_sql_fixed('qed_weighted', 3)} as qed_text,
  {_sql_fixed('psa', 1)} as psa_text from compounds""")
def fixed_decimal_text(spark, d):
    """fixed-decimal text (1, 2 and 3 places; signed), 'nan' for missing."""
    c = B.compounds(spark, d)
    return c.select("row_id", T.fixed("molecular_weight", 1).alias("mw_text"), T.fixed("alogp", 2).alias("logp_text"),
                    T.signed_fixed("alogp", 1).alias("logp_signed"), T.fixed("qed_weighted", 3).alias("qed_text"),
                    T.fixed("psa", 1).alias("psa_text"))
