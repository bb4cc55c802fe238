"""Ordered operators over sampled ranges, against windows and plain folds: many ranges, any
key type, ties, nulls, hot groups, empty and one-sided tables."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pharmlake.operators import history as H
from pharmlake.operators import metrics as M
from pharmlake.operators import ranking as RK
from pharmlake.operators import splits as S
from pharmlake.operators.joins import pair_by_rank
from pharmlake.sources.nested import batch_keys

SCHEMA = "id int, g string, s string, d date, x decimal(12,2), v double, t timestamp"


def rows(n, seed=0):
    rng = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    return [(i, rng.choice([None, "a", "hot", "hot", "hot", "b" * 80]),
             rng.choice([None, "", "Zürich", "b" * 80, "b" * 80 + "c", f"k{rng.randrange(50)}"]),
             rng.choice([None, day + datetime.timedelta(rng.randrange(40))]), rng.choice([None, Decimal(rng.randrange(900)) / 100]),
             rng.choice([None, float("nan"), -0.0, 0.0, float("inf"), rng.random()]),
             datetime.datetime(2021, 1, 1) + datetime.timedelta(seconds=rng.randrange(500))) for i in range(n)]


@pytest.mark.parametrize("order", [["s", "id"], ["d", "x", "id"], ["v", "id"], ["t", "s", "id"]])
@pytest.mark.parametrize("part", [[], ["g", "d"]])
def test_rank_equals_window(spark, order, part):
    df = spark.createDataFrame(rows(900), SCHEMA).repartition(5)
    one = df.withColumn("w", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    got = RK.ranked(one, order, "rn", part, rows_per_range=40)
    assert got.columns == one.columns + ["rn"]
    out = got.select("id", "w", "rn").collect()
    assert len(out) == 900 and all(r.w == r.rn for r in out)


def test_ranges_are_balanced_and_bounded(spark):
    df = spark.createDataFrame(rows(4000), SCHEMA)
    r = RK.Ranges.of(df, ["s", "id"], rows_per_range=100)
    assert 10 <= len(r.bounds) <= 40
    assert RK.Ranges.of(df, ["s", "id"]).bounds == []
    sizes = [x["count"] for x in df.groupBy(r.index().alias("r")).count().collect()]
    assert max(sizes) < 1600  # the long strings, a third of the rows, agree in the short key


def test_empty_all_null_and_one_sided(spark):
    none = spark.createDataFrame([], SCHEMA)
    null = spark.createDataFrame([(None,) * 7] * 50, SCHEMA)
    for order in (["s"], ["v"], ["d", "x"]):
        assert H.rank_in(none, ["g"], order).collect() == []
        assert RK.row_number_by_key(none, order[0]).collect() == []
        for per in (None, 7):
            assert sorted(r.rn for r in H.rank_in(null, ["g"], order, rows_per_range=per).collect()) == list(range(1, 51))
            assert sorted(r.rn for r in RK.row_number_by_key(null, order[0], rows_per_range=per).collect()) == list(range(1, 51))
    some = spark.createDataFrame(rows(20), SCHEMA)
    assert pair_by_rank(some, none, "s").collect() == [] and pair_by_rank(none, some, "s").collect() == []
    assert pair_by_rank(some, null, "s").count() == 20
    assert batch_keys(none, "s").collect() == []
    assert sum(r.n for r in batch_keys(spark.createDataFrame([(f"k{i}",) for i in range(25)], "s string"), "s", 10).collect()) == 25
    assert H.early_stop(spark.createDataFrame([], "run_id int, epoch int, val_loss double")).collect() == []
    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert H.last_turns(turns).collect() == [] and H.chat_context(turns).collect() == []


def test_pairs_of_string_keys(spark):
    a = spark.createDataFrame([("c",), ("a",), (None,)], "k string")
    b = spark.createDataFrame([("z",), ("y",)], "k string")
    assert sorted((r.pair_rank, r.d1_k, r.d2_k) for r in pair_by_rank(a, b, "k").collect()) == [(1, None, "y"), (2, "a", "z")]


@pytest.mark.parametrize("n", [0, 137, 900, 2000])
def test_selection_of_many_rows(spark, n):
    df = spark.createDataFrame(rows(900), SCHEMA).repartition(4)
    want = {r.id for r in df.orderBy("s", "id").limit(n).collect()}
    big = RK.first_n(df, ["s", "id"], n, rows_per_range=50)
    assert {r.id for r in big.collect()} == want and big.columns == df.columns
    assert {r.id for r in RK.first_n(df, ["s", "id"], n, "rn", rows_per_range=50).collect()} == want
    seeded = {r.id for r in S.sample_n(df, n, "id", 7).collect()}
    assert {r.id for r in RK.sampled_first_n(df, "id", n, 7, rows_per_range=0 or 1).collect()} == seeded


def test_large_selection_has_no_global_sort(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    plan = RK.first_n(df, ["k"], 1500, rows_per_range=100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan


def fold_stop(history, patience=3, delta=0.001):
    out = {}
    for run in {h[0] for h in history}:
        best, counter, stop = None, 0, None
        mine = sorted((h for h in history if h[0] == run), key=lambda h: (h[1] is not None, h[1] or 0, h[2] is not None, h[2] or 0))
        for _, epoch, s in mine:
            if stop is not None:
                break
            if best is None:
                best = s
            elif s is not None and s < best - delta:
                best, counter = s, 0
            else:
                counter += 1
                stop = epoch if counter >= patience else None
        out[run] = (stop, best)
    return out


@pytest.mark.parametrize("patience,per", [(1, 5), (3, 2), (7, 11), (40, 6)])
def test_early_stop_over_blocks_equals_fold(spark, patience, per):
    rng = random.Random(patience * 100 + per)
    history = []
    for run in [None, *range(12)]:
        level, gap = rng.random() * 5, rng.choice([1, 3])
        for e in range(rng.choice([1, 3, 60, 200])):
            level -= rng.choice([0, 0, 0.0005, 0.01, 0.01, 0.3])
            history.append((run, e * gap, rng.choice([None, level, level, level + rng.random() * 0.02])))
    history += [(99, e, None) for e in range(30)] + [(98, 1, 0.5), (98, 1, 0.4), (98, 2, 0.39999), (98, None, 0.7)]
    df = spark.createDataFrame(history, "run_id int, epoch int, val_loss double").repartition(3)
    got = {r.run_id: (r.stop_epoch, r.best_score) for r in H.early_stop(df, patience, rows_per_range=per).collect()}
    assert got == fold_stop(history, patience)


def test_long_run_in_many_blocks(spark):
    history = [(1, e, 100.0 - e * 0.5 + (e % 3) * 0.7) for e in range(5000)]
    df = spark.createDataFrame(history, "run_id int, epoch int, val_loss double")
    got = H.early_stop(df, 3, rows_per_range=64).collect()
    assert {r.run_id: (r.stop_epoch, r.best_score) for r in got} == fold_stop(history)
    up = H.early_stop(df.withColumn("val_loss", -F.col("val_loss")), 3, mode="max", rows_per_range=64).first()
    assert (up.stop_epoch, -up.best_score) == fold_stop(history)[1]


@pytest.mark.parametrize("per,n", [(3, 3), (10, 1), (None, 3)])
def test_last_turns_over_ranges_equals_fold(spark, per, n):
    rng = random.Random(5)
    turns = [(c, rng.choice([None, t, t, 4]), rng.choice(["user", "user", "assistant", "system"]), rng.choice([None, f"{c}.{t}", "same"]))
             for c in [None, 1, 2] for t in range(rng.choice([1, 6, 25]))]
    turns += [(7, t, "assistant" if t % 9 else "user", f"x{t}") for t in range(60)] + [(7, 5, "assistant", "x5")]
    want = []
    nulls = lambda x: (x is not None, x if x is not None else 0)
    for c in {t[0] for t in turns}:
        mine, pairs = sorted((t for t in turns if t[0] == c), key=lambda t: (nulls(t[1]), t[2], (t[3] is not None, t[3] or ""))), []
        for i, (_, t, role, text) in enumerate(mine):
            if role == "user":
                reply = mine[i + 1][3] if i + 1 < len(mine) and mine[i + 1][2] == "assistant" else None
                want.append((c, t, text, reply, tuple(pairs[-n:])))
                pairs.append((text, reply))
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(3)
    got = [(r.conv_id, r.turn, r.message, r.reply, tuple((p.user, p.assistant) for p in r.history))
           for r in H.last_turns(df, n, rows_per_range=per).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


@pytest.mark.parametrize("per", [None, 9])
def test_curves_and_metrics_over_ranges(spark, per):
    rng = random.Random(3)
    data = [(m, rng.randrange(2), rng.choice([0.1, 0.5, round(rng.random(), 2)])) for m in ["a"] * 30 + ["b"] * 400]
    df = spark.createDataFrame([(i, *d, int(d[2] > 0.5)) for i, d in enumerate(data)], "id int, model string, label int, score double, pred int")
    got = {r.model: r.roc_auc for r in M.ranking_metrics(df, ["model"], rows_per_range=per).collect()}
    shared = {r.model: r for r in M.model_metrics(df).collect()}
    for m in "ab":
        mine = [(s, y) for k, y, s in data if k == m]
        assert got[m] == pytest.approx(auc(mine)) and shared[m].roc_auc == pytest.approx(auc(mine))
        assert shared[m].accuracy == pytest.approx(sum(y == (s > 0.5) for s, y in mine) / len(mine))
    none = df.where("id < 0")
    assert M.score_curve(none, ["model"]).collect() == [] and M.ranking_metrics(none, ["model"]).collect() == []
    assert M.report_rows(none, "a", "b").collect() == []
    null = M.ranking_metrics(df.withColumn("score", F.lit(None).cast("double")), ["model"], rows_per_range=per).collect()
    assert {r.model: r.roc_auc for r in null} == {"a": 0.5, "b": 0.5}


def test_report_reads_the_rows_once(spark, tmp_dir):
    df = spark.range(200).selectExpr("id", "if(id % 2 = 0, 'old', 'new') model", "cast(id % 3 = 0 as int) label",
                                     "(id % 7) / 7.0 score", "cast(id % 5 > 2 as int) pred")
    df.write.parquet(f"{tmp_dir}/rows")
    plan = M.report_rows(spark.read.parquet(f"{tmp_dir}/rows"), "old", "new")._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_dir}/rows" not in plan  # the rows were read when the shared table was written
    assert "SortMergeJoin" not in plan and plan.count("Exchange") <= 4
