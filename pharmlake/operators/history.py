"""Run histories and ordered state.

Ordered state is computed over sampled ranges of (group, order): a group larger than a
range is cut, and what crosses a cut (offsets, neighbours, block summaries) is a table
bounded by the number of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import IM_START
from ..functions.text import assistant_block, user_block
from .ranking import Ranges, ranked, top_n_per_group


def rank_in(df: DataFrame, part: Sequence[str], order: Sequence[str] | str, name: str = "rn",
            rows_per_range: int | None = None) -> DataFrame:
    """Row position within a group, by order columns of any type. Sampled ranges of
    (group, order) split a hot group across tasks, and range offsets are joined back. Null
    groups are groups; null order keys come first; an empty table gives no rows."""
    return ranked(df, [order] if isinstance(order, str) else list(order), name, list(part), rows_per_range)


def best_epoch(history: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """First epoch with the minimum loss (strictly lower replaces), per run. Null
    losses never win; a run without any loss has a null epoch."""
    key = F.when(F.col(loss).isNotNull(), F.struct(F.col(loss), F.col(epoch)))
    return history.groupBy(run).agg(
        F.min_by(F.col(epoch), key).alias("best_epoch"),
        F.min(loss).alias("best_loss"))


def early_stop(history: DataFrame, patience: int = 3, min_delta: float = 0.001, mode: str = "min",
               run: str = "run_id", epoch: str = "epoch", score: str = "val_loss",
               rows_per_range: int = 100_000) -> DataFrame:
    """Early stopping per run, without holding a run in one task.

    State: (best, counter). An epoch improves only if it beats the best *accepted*
    score by min_delta, so this is not a running minimum. Output per run: the first
    epoch at which training stops (null if never) and the best score seen up to that
    point (or to the end).

    Runs are cut into blocks at sampled splitters of (run, epoch, score). A block that
    starts with some best b accepts its first improvement within its first ``patience``
    epochs or stops there, and after an acceptance nothing depends on b any more. So a
    block is summarised by, for each of those epochs, the outcome if it is the first one
    accepted, and by the outcome if no score came before; the summaries of a run (one per
    block) are composed in order. Epochs are taken by position, so gaps do not matter; rows
    with one epoch are ordered by score; epochs before the first score are skipped; later
    null scores do not improve. A patience below 1 acts as 1: the first epoch that does not
    improve stops. An empty table gives no rows."""
    patience = max(1, patience)
    rows = history.select(F.col(run).alias("r"), F.col(epoch).alias("e"), F.col(score).cast("double").alias("s"))
    ranges = Ranges.of(rows, ["r", "e", "s"], rows_per_range)
    type_e = dict(rows.dtypes)["e"]

    def state(best: Column, counter: Column, stop: Column) -> Column:
        return F.struct(best.cast("double").alias("best"), counter.cast("int").alias("counter"), stop.cast(type_e).alias("stop"))

    none = F.lit(None)
    fresh = state(none, F.lit(0), none)

    def improves(s: Column, best: Column) -> Column:
        return F.coalesce((s < best - min_delta) if mode == "min" else (s > best + min_delta), F.lit(False))

    def step(at: Column, x: Column) -> Column:
        waited = at["counter"] + 1
        return F.when(at["stop"].isNotNull(), at) \
            .when(at["best"].isNull(), state(x["s"], F.lit(0), none)) \
            .when(improves(x["s"], at["best"]), state(x["s"], F.lit(0), none)) \
            .otherwise(state(at["best"], waited, F.when(waited >= patience, x["e"])))

    def fold(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, start, step)

    cut = rows.select("r", F.struct("e", "s").alias("x"), ranges.index().alias("b"), ranges.straddles(1).alias("split"))
    blocks = cut.groupBy("r", "b", "split").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    places = F.when(F.col("split"), F.sequence(F.lit(1), F.least(F.lit(patience), F.size("xs")))) \
        .otherwise(F.array().cast("array<int>"))
    blocks = blocks.select("r", F.struct(
        "b", F.size("xs").alias("n"), fold(F.col("xs"), fresh).alias("fresh"),
        F.transform(places, lambda i: F.struct(
            F.get("xs", i - 1).alias("x"),
            fold(F.slice("xs", i + 1, F.size("xs")), state(F.get("xs", i - 1)["s"], F.lit(0), none)).alias("then"))).alias("heads")
    ).alias("block"))

    def compose(at: Column, block: Column) -> Column:
        left = F.lit(patience) - at["counter"]  # epochs that may still fail
        reach = F.slice(block["heads"], F.lit(1), left)
        accepted = F.filter(reach, lambda h: improves(h["x"]["s"], at["best"]))
        return F.when(at["stop"].isNotNull(), at) \
            .when(at["best"].isNull(), block["fresh"]) \
            .when(F.size(accepted) > 0, F.get(accepted, F.lit(0))["then"]) \
            .when(block["n"] >= left, state(at["best"], F.lit(patience), F.get(block["heads"], left - 1)["x"]["e"])) \
            .otherwise(state(at["best"], at["counter"] + block["n"], none))

    runs = blocks.groupBy("r").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    # a first block is always entered without a best, so its heads are never asked for
    ends = runs.select("r", F.aggregate("blocks", fresh, compose).alias("end"))
    return ends.select(F.col("r").alias(run), F.col("end.stop").cast("int").alias("stop_epoch"),
                       F.col("end.best").alias("best_score"))


def last_turns(turns: DataFrame, n: int = 3, conv: str = "conv_id", turn: str = "turn",
               role: str = "role", text: str = "text", rows_per_range: int | None = None) -> DataFrame:
    """For each user turn, its reply (the next turn if it is the assistant's) and
    the last n (user, assistant) pairs before it, oldest first.

    Turns are in the order (turn, role, text), nulls first, so ties are settled. Sampled
    splitters cut that order into ranges; inside a (conversation, range) a lead and n lags
    in one exchange give reply and history. A conversation that straddles a splitter gets a
    halo: the first turn of its next range, and the last n pairs of the ranges before. There
    are at most 2 x 4096 such (conversation, range) pairs; without splitters Catalyst drops
    the halo side. A null conversation is one conversation."""
    order = ["__t", "__role", "__text"]
    base = turns.select(F.col(conv).alias("__c"), F.col(turn).alias("__t"), F.col(role).alias("__role"),
                        F.col(text).alias("__text"))
    ranges = Ranges.of(base, ["__c", *order], rows_per_range)
    cut = base.withColumns({"__r": ranges.index(), "__s": ranges.straddles(1)})
    here = Window.partitionBy("__c", "__r").orderBy(*order)
    following = Window.partitionBy("__c").orderBy("__r")
    first = cut.where("__s").groupBy("__c", "__r").agg(F.min(F.struct(*order)).alias("__first"))
    heads = first.select(F.col("__c").alias("__hc"), F.col("__r").alias("__hr"), F.lead("__first").over(following).alias("__head"))

    def answered(rows: DataFrame) -> DataFrame:
        """User turns with their replies; the last turn of a range asks the halo."""
        nxt = F.lead(F.struct("__role", "__text")).over(here)
        rows = rows.withColumns({"__next": nxt, "__n": F.row_number().over(here)}).where(F.col("__role") == "user")
        rows = rows.join(heads, F.col("__c").eqNullSafe(F.col("__hc")) & (F.col("__r") == F.col("__hr")), "left")
        got = F.coalesce("__next", F.struct(F.col("__head.__role").alias("__role"), F.col("__head.__text").alias("__text")))
        return rows.select("__c", "__r", "__s", "__n", "__t", "__text", F.when(got["__role"] == "assistant", got["__text"]).alias("__reply"))

    pair = F.struct(F.col("__text").alias("user"), F.col("__reply").alias("assistant"))
    users = answered(cut)
    # the last n pairs of every range of a straddling conversation, then of the ranges before it
    placed = Window.partitionBy("__c", "__r").orderBy("__n")  # equal turns keep the place they got
    back = Window.partitionBy("__c", "__r").orderBy(F.desc("__n"))
    tails = answered(cut.where("__s")).withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= n)
    tails = tails.groupBy("__c", "__r").agg(F.array_sort(F.collect_list(F.struct((-F.col("__k")).alias("k"), pair.alias("p")))).alias("__tail"))
    earlier = F.flatten(F.collect_list("__tail").over(following.rowsBetween(-n, -1)))
    halo = tails.select(F.col("__c").alias("__hc"), F.col("__r").alias("__hr"), F.transform(earlier, lambda x: x["p"]).alias("__halo"))
    lags = F.array(*[F.lag(pair, k).over(placed) for k in range(n, 0, -1)])
    users = users.withColumn("__own", F.filter(lags, lambda x: x.isNotNull()))
    out = users.join(halo, F.col("__c").eqNullSafe(F.col("__hc")) & (F.col("__r") == F.col("__hr")), "left")
    both = F.concat(F.coalesce("__halo", F.array().cast(dict(halo.dtypes)["__halo"])), F.col("__own"))
    return out.select(F.col("__c").alias(conv), F.col("__t").alias(turn), F.col("__text").alias("message"),
                      F.col("__reply").alias("reply"),
                      F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n)).alias("history"))


def chat_context(turns: DataFrame, n: int = 3, **kw) -> DataFrame:
    """ChatML context: last n pairs + current message + an open assistant block."""
    lt = last_turns(turns, n, **{k: v for k, v in kw.items()})
    ctx = F.aggregate(F.col("history"), F.lit(""),
                      lambda acc, p: F.concat(acc, user_block(p["user"]), assistant_block(p["assistant"])))
    prompt = F.concat(ctx, user_block("message"), F.lit(f"{IM_START}assistant\n"))
    return lt.select(kw.get("conv", "conv_id"), kw.get("turn", "turn"), F.size("history").alias("pairs"),
                     prompt.alias("prompt"))


def retain_latest(runs: DataFrame, n: int, run: str = "run_id", key: str = "checkpoint") -> DataFrame:
    """Keep the newest n checkpoints per run (by key, descending), flag the rest.

    The newest n per run come from a salted two-round top-n (a hot run is spread
    over tasks); the flag is a null-safe left join on (run, key). Repeated (run, key)
    rows are one checkpoint: they share its flag."""
    keep = top_n_per_group(runs.select(run, key).distinct(), [run], [F.col(key).desc()], n).select(
        F.col(run).alias("__run"), F.col(key).alias("__key"), F.lit(True).alias("__keep"))
    j = runs.join(keep, F.col(run).eqNullSafe(F.col("__run")) & F.col(key).eqNullSafe(F.col("__key")), "left") \
        .drop("__run", "__key")
    return j.withColumn("keep", F.coalesce(F.col("__keep"), F.lit(False))).drop("__keep")


def latest_run(runs: DataFrame, name: str = "run_name", by: Sequence[str] = (),
               key: str = "checkpoint") -> DataFrame:
    """Latest run by name (names sort by time); ties broken by the larger key."""
    w = F.max(F.struct(F.col(name), F.col(key))).alias("__m")
    return runs.groupBy(*by).agg(w).select(*by, F.col("__m")[name].alias("latest_name"),
                                          F.col("__m")[key].alias("latest_" + key))


def epoch_metrics(batches: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Mean batch loss and accuracy = correct / total per (run, epoch)."""
    return batches.groupBy(run, epoch).agg(
        F.avg("loss").alias("avg_loss"),
        (F.sum("correct").cast("double") / F.sum("total")).alias("accuracy"),
        F.count(F.lit(1)).alias("batches"))


def history_from_document(doc: DataFrame, metrics: Sequence[str], run: str = "run_id") -> DataFrame:
    """Metric history document (one row per run, one array per metric, as saved by a
    training loop) to one row per (run, epoch) with the metrics as columns. Epochs
    are 1-based positions; arrays of different lengths leave nulls."""
    zipped = F.arrays_zip(*[F.col(m) for m in metrics])
    exploded = doc.select(run, F.posexplode(zipped).alias("__pos", "__m"))
    return exploded.select(run, (F.col("__pos") + 1).alias("epoch"),
                           *[F.col("__m")[m].alias(m) for m in metrics])


def history_to_document(history: DataFrame, metrics: Sequence[str], run: str = "run_id",
                        epoch: str = "epoch") -> DataFrame:
    """Per-epoch rows back to one row per run with one epoch-ordered array per metric
    (a run's history is one row per epoch, bounded by the training length)."""
    packed = history.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"),
                                                                           *[F.col(m) for m in metrics])))
                                      .alias("__h"))
    def field(m: str):
        return lambda x: x[m]  # one-argument lambda: transform passes the index to a second one

    return packed.select(run, *[F.transform("__h", field(m)).alias(m) for m in metrics])
