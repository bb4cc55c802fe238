"""Queries: limits, seeded samples, shuffles, splits, batches (L, T, S20, S22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators.ranking import row_number_by_key
from ..oracle_bindings import with_bindings as W
from ..sources import bindings as B
from . import register

MD5_DOC = "md5('42:' || cast(doc_id as varchar))"


@register("head_approved", W("compounds") + """
select row_id, name from compounds where status = 'approved' order by row_id limit 200""")
def head_approved(spark, d):
    c = B.compounds(spark, d).where(F.col("status") == "approved").select("row_id", "name")
    return S.head_n(c, 200, ["row_id"])


@register("sample_documents", f"select doc_id, lang from documents order by {MD5_DOC}, doc_id limit 100")
def sample_documents(spark, d):
    return S.sample_n(B.tokens(spark, d).select("doc_id", "lang"), 100, "doc_id", 42)


@register("shuffle_documents", f"""
select doc_id, row_number() over (order by {MD5_DOC}, doc_id) as position from documents""")
def shuffle_documents(spark, d):
    return S.shuffle(B.tokens(spark, d).select("doc_id"), "doc_id", 42)


@register("template_choice", W("compounds") + """
select row_id, cast(cast(('0x' || substr(md5('42:' || cast(row_id as varchar)), 1, 8)) as bigint) % 5 as int) as template
from compounds""")
def template_choice(spark, d):
    return B.compounds(spark, d).select("row_id", S.pick_index("row_id", 5, 42).alias("template"))


@register("cap_checkpoints", W("checkpoints") + """
select run_id, checkpoint from checkpoints order by checkpoint limit 1000""")
def cap_checkpoints(spark, d):
    return S.cap_rows(B.checkpoints(spark, d).select("run_id", "checkpoint"), 1000, ["checkpoint"])


@register("cap_per_source", W("compounds") + """
select row_id, source from (select *, row_number() over (partition by source order by row_id) rn from compounds) where rn <= 50""")
def cap_per_source(spark, d):
    return S.cap_per(B.compounds(spark, d).select("row_id", "source"), "source", 50, ["row_id"])


@register("language_counts", "select lang, count(*) as count from documents group by lang order by count desc, lang")
def language_counts(spark, d):
    from ..operators.metrics import value_counts

    return value_counts(B.tokens(spark, d), "lang")


SPLIT_SQL = f"""
, r AS (select doc_id, row_number() over (order by {MD5_DOC}, doc_id) as position, count(*) over () as n from documents),
s AS (select doc_id, position, case when position <= floor(0.85 * n::double) then 'train'
  when position <= floor(0.95 * n::double) then 'val' else 'test' end as split from r)
"""


@register("split_documents", "WITH x AS (select 1)" + SPLIT_SQL + "select doc_id, position, split from s")
def split_documents(spark, d):
    return S.split_positional(B.tokens(spark, d).select("doc_id"), "doc_id", (0.85, 0.95), 42)


@register("split_document_stats", "WITH x AS (select 1)" + SPLIT_SQL + """
, g AS (select split, count(*) as n from s group by split) select split, n, round(n::double / sum(n) over (), 6) as share from g""")
def split_document_stats(spark, d):
    s = S.split_stats(split_documents(spark, d))
    return s.select("split", "n", F.round("share", 6).alias("share"))


@register("small_run_caps", "WITH x AS (select 1)" + SPLIT_SQL + """
select * from (select doc_id, split from s where split = 'train' order by position limit 100)
union all select * from (select doc_id, split from s where split = 'val' order by position limit 20)""")
def small_run_caps(spark, d):
    s = split_documents(spark, d)
    tr = S.cap_rows(s.where(F.col("split") == "train"), 100, ["position"])
    va = S.cap_rows(s.where(F.col("split") == "val"), 20, ["position"])
    return tr.unionByName(va).select("doc_id", "split")


@register("kfold_compounds", W("compounds") + """
, u AS (select compound_id, case when status = 'approved' then 1 else 0 end as label from compounds)
select compound_id, label, cast((row_number() over (partition by label order by md5('42:' || compound_id), compound_id) - 1) % 5 as int) as fold
from u""")
def kfold_compounds(spark, d):
    from ..operators.clean import map_label

    u = B.compounds(spark, d).select("compound_id", map_label("status").alias("label"))
    return S.kfold(u, "label", "compound_id", 5, 42)


@register("batch_document_keys", """
, r AS (select doc_id, row_number() over (order by doc_id) as rn from documents)
select cast((rn - 1) // 100 as bigint) as batch, string_agg(cast(doc_id as varchar), ',' order by doc_id) as keys, count(*) as n
from r group by 1""".replace(", r AS", "WITH r AS", 1))
def batch_document_keys(spark, d):
    """Keys in batches of 100 (global key order via quantile buckets)."""
    r = row_number_by_key(B.tokens(spark, d).select("doc_id"), "doc_id", "rn")
    g = r.groupBy(F.floor((F.col("rn") - 1) / 100).cast("bigint").alias("batch")).agg(
        F.array_sort(F.collect_list("doc_id")).alias("ks"), F.count(F.lit(1)).alias("n"))
    return g.select("batch", F.array_join(F.transform("ks", lambda x: x.cast("string")), ",").alias("keys"), "n")
