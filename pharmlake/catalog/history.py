"""Queries: run histories, checkpoints, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import run_name
from ..operators import history as H
from ..oracle_bindings import with_bindings as W
from ..sources import bindings as B
from . import register
from .texts import sql_text


@register("rank_within_status", W("compounds") + """
select row_id, status, row_number() over (partition by status order by row_id) as rn from compounds""")
def rank_within_status(spark, d):
    c = B.compounds(spark, d).select("row_id", "status")
    return H.rank_in(c, ["status"], "row_id", "rn")


@register("best_epoch", W("run_history") + """
select run_id, arg_min(epoch, (val_loss, epoch)) as best_epoch, round(min(val_loss), 6) as best_loss from run_history group by run_id""")
def best_epoch(spark, d):
    b = H.best_epoch(B.run_history(spark, d))
    return b.select("run_id", F.col("best_epoch").cast("bigint").alias("best_epoch"), F.round("best_loss", 6).alias("best_loss"))


EARLY_SQL = """WITH RECURSIVE h AS (
  select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch, value / 100 as val_loss
  from events),
s(run_id, epoch, best, counter, stop) AS (
  select run_id, epoch, val_loss, 0, null::bigint from h where epoch = 1
  union all
  select s.run_id, h.epoch,
    case when h.val_loss < s.best - 0.001 then h.val_loss else s.best end,
    case when h.val_loss < s.best - 0.001 then 0 else s.counter + 1 end,
    case when not (h.val_loss < s.best - 0.001) and s.counter + 1 >= 3 then h.epoch end
  from s join h on h.run_id = s.run_id and h.epoch = s.epoch + 1
  where s.stop is null)
select run_id, max(stop) as stop_epoch, round(arg_max(best, epoch), 6) as best_score from s group by run_id"""


@register("early_stopping", EARLY_SQL)
def early_stopping(spark, d):
    e = H.early_stop(B.run_history(spark, d), patience=3, min_delta=0.001)
    return e.select("run_id", F.col("stop_epoch").cast("bigint").alias("stop_epoch"), F.round("best_score", 6).alias("best_score"))


@register("retain_latest_checkpoints", W("checkpoints") + """
select run_id, checkpoint, coalesce(row_number() over (partition by run_id order by checkpoint desc) <= 3, false) as keep
from checkpoints""")
def retain_latest_checkpoints(spark, d):
    return H.retain_latest(B.checkpoints(spark, d).select("run_id", "checkpoint"), 3)


@register("latest_run", W("checkpoints") + """
, n AS (select run_id, checkpoint, 'run_' || strftime(saved_at, '%Y%m%d_%H%M%S') as run_name from checkpoints)
select run_id, max(run_name) as latest_name, arg_max(checkpoint, (run_name, checkpoint)) as latest_checkpoint from n group by run_id""")
def latest_run(spark, d):
    c = B.checkpoints(spark, d).withColumn("run_name", run_name("saved_at"))
    return H.latest_run(c, "run_name", ["run_id"])


@register("epoch_metrics", W("batches") + """
select run_id, epoch, round(avg(loss), 6) as avg_loss, round(sum(correct)::double / sum(total), 6) as accuracy, count(*) as batches
from batches group by run_id, epoch""")
def epoch_metrics(spark, d):
    e = H.epoch_metrics(B.batches(spark, d))
    return e.select("run_id", "epoch", F.round("avg_loss", 6).alias("avg_loss"), F.round("accuracy", 6).alias("accuracy"),
                    "batches")


TURNS_SQL = """WITH t AS (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role,
  lead(text) over (partition by conv_id order by turn) as next_text from conversations),
u AS (select conv_id, turn, text as message, case when next_role = 'assistant' then next_text end as reply from t where role = 'user'),
l AS (select conv_id, turn, message, reply,
  lag(message, 3) over w as u3, lag(reply, 3) over w as a3, lag(turn, 3) over w as t3,
  lag(message, 2) over w as u2, lag(reply, 2) over w as a2, lag(turn, 2) over w as t2,
  lag(message, 1) over w as u1, lag(reply, 1) over w as a1, lag(turn, 1) over w as t1
  from u window w as (partition by conv_id order by turn))
"""


def _blk(role, x):
    return f"{sql_text(f'{V.IM_START}{role}' + chr(10))} || {x} || {sql_text(chr(10) + V.IM_END + chr(10))}"


@register("last_turns", TURNS_SQL + """
select conv_id, turn, (t3 is not null)::int + (t2 is not null)::int + (t1 is not null)::int as pairs,
  coalesce(u1, '') as last_user, coalesce(a1, '') as last_assistant from l""")
def last_turns(spark, d):
    lt = H.last_turns(B.chats(spark, d))
    last = F.try_element_at("history", F.lit(-1))
    return lt.select("conv_id", "turn", F.size("history").alias("pairs"),
                     F.coalesce(last["user"], F.lit("")).alias("last_user"),
                     F.coalesce(last["assistant"], F.lit("")).alias("last_assistant"))


@register("chat_context", TURNS_SQL + f"""
select conv_id, turn, (t3 is not null)::int + (t2 is not null)::int + (t1 is not null)::int as pairs,
  case when t3 is not null then {_blk('user', 'u3')} || {_blk('assistant', 'a3')} else '' end ||
  case when t2 is not null then {_blk('user', 'u2')} || {_blk('assistant', 'a2')} else '' end ||
  case when t1 is not null then {_blk('user', 'u1')} || {_blk('assistant', 'a1')} else '' end ||
  {_blk('user', 'message')} || {sql_text(V.IM_START + 'assistant' + chr(10))} as prompt from l""")
def chat_context(spark, d):
    return H.chat_context(B.chats(spark, d))
