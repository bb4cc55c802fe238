"""The same bindings as ANSI SQL for the DuckDB oracle (views over the driver's tables).

Each constant is a ``name AS (...)`` common table expression; ``with_bindings``
prefixes a query with the ones it names.
"""

from __future__ import annotations

COMPOUNDS = """compounds AS (
select p_partkey as row_id, concat('CMP', cast(p_partkey as varchar)) as compound_id, p_name as name,
  case when p_partkey % 19 = 0 then null when p_partkey % 13 = 0 then 'N/A (Antibody)'
       when p_partkey % 31 = 0 then 'NC[C@H](N)O'
       else concat(repeat('C', cast(1 + p_size % 6 as int)), '(=O)N', repeat('c', cast(p_partkey % 97 as int))) end as smiles,
  case when p_type in ('ECONOMY','STANDARD','LARGE') then 'chembl' when p_type = 'PROMO' then 'drugbank'
       when p_type = 'SMALL' then 'fda_failed' else 'fda_novel' end as source,
  case when p_type in ('ECONOMY','STANDARD') then 'approved' when p_type = 'LARGE' then 'failed'
       when p_type = 'SMALL' then 'withdrawn' when p_type = 'MEDIUM' then 'experimental'
       when p_size % 2 = 0 then 'approved' else 'withdrawn' end as status,
  cast(p_partkey % 5 as int) as max_phase,
  case when p_partkey % 29 = 0 then null else cast(100 + (p_partkey * 37) % 700 as double) end as molecular_weight,
  case when p_partkey % 23 = 0 then null else cast(p_size - 8 as double) / 8 end as alogp,
  cast(p_partkey % 14 as int) as hba, cast(p_partkey % 8 as int) as hbd,
  cast(p_size * 4 as double) as psa, cast(p_partkey % 13 as int) as rtb,
  cast(p_partkey % 3 as int) as num_ro5_violations,
  cast(p_partkey % 101 as double) / 100 as qed_weighted, p_partkey % 9 = 0 as natural_product
from part)"""

FAILURES = """failures AS (
select o_orderkey as row_id, concat('Trial ', cast(o_orderkey as varchar)) as name,
  case o_orderstatus when 'F' then 'Phase III' when 'O' then 'Phase II' else 'Post-market' end as phase_failed,
  case when o_orderkey % 7 = 0 then null else concat('Signal in arm ', cast(o_custkey as varchar)) end as failure_reason,
  case when o_orderkey % 3 = 0 then 'Safety' end as warning_type,
  case o_orderpriority when '1-URGENT' then 'Cardiotoxicity' when '2-HIGH' then 'Hepatotoxicity'
       when '3-MEDIUM' then 'Lack of Efficacy' when '5-LOW' then 'Cardiovascular/Liver' else 'Pharmacokinetics' end as failure_category,
  case when o_orderkey % 2 = 0 then 'clinical_trial_failures' else 'drug_withdrawals' end as source,
  cast(extract(year from o_orderdate) as int) as year
from orders)"""

SCORED = """scored AS (
select l.doc_id as id, d.lang as model, l.quality as label,
  cast(d.n_chars % 97 as double) / 97 as score, case when d.n_chars % 97 >= 30 then 1 else 0 end as pred
from labels l join documents d on l.doc_id = d.doc_id)"""

LOGITS = """logits AS (
select vec_id as id, label, cast(embedding as double[]) as logits from embeddings)"""

RESPONSES = """responses AS (
select conv_id, turn, concat('type', cast(conv_id % 5 as varchar)) as prompt_type, text as response,
  length(text) as response_length,
  case when conv_id % 6 = 0 then '' when conv_id % 2 = 0 then 'the,tion,zzz' else 'er,Of' end as keywords
from conversations where role = 'assistant')"""

RUN_HISTORY = """run_history AS (
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch,
  value / 100 as val_loss
from events)"""

BATCHES = """batches AS (
select l_returnflag as run_id, l_linenumber as epoch, l_discount as loss,
  case when l_linestatus = 'O' then 1 else 0 end as correct, 1 as total
from lineitem)"""

CHECKPOINTS = """checkpoints AS (
select o_custkey as run_id, o_orderkey as checkpoint, o_orderdate as saved_at from orders)"""

TOKENS = """tokens AS (select doc_id, text, lang, source from documents)"""

ALL = {
    "compounds": COMPOUNDS, "failures": FAILURES, "scored": SCORED, "logits": LOGITS,
    "responses": RESPONSES, "run_history": RUN_HISTORY, "batches": BATCHES,
    "checkpoints": CHECKPOINTS, "tokens": TOKENS,
}


def with_bindings(*names: str) -> str:
    return "WITH " + ",\n".join(ALL[n] for n in names) + "\n"
