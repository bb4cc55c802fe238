"""Golden tests from the reference's published result files."""

import pytest
from pyspark.sql import functions as F

from pharmlake.operators import history as H
from pharmlake.operators import metrics as M
from pharmlake.operators.splits import split_stratified


def _labels_preds(spark, tp, tn, fp, fn):
    rows = [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn
    return spark.createDataFrame(rows, "label int, pred int")


def test_confusion_and_classification_metrics(spark):
    df = _labels_preds(spark, 117, 447, 54, 192)
    m = M.classification_metrics(df).first()
    assert (m.tp, m.tn, m.fp, m.fn) == (117, 447, 54, 192)
    assert m.accuracy == pytest.approx(0.6962962962962963)
    assert m.precision == pytest.approx(0.6842105263157895)
    assert m.recall == pytest.approx(0.3786407766990291)
    assert m.specificity == pytest.approx(0.8922155688622755)
    assert m.f1_score == pytest.approx(0.4875)
    assert m.macro_f1 == pytest.approx(0.6358552631578948)


def test_majority_baseline(spark):
    df = spark.createDataFrame([(1,)] * 309 + [(0,)] * 501, "label int")
    m = M.majority_baseline(df).first()
    assert m.majority_class == 0
    assert m.accuracy == pytest.approx(0.6185185185185185)
    assert m.f1_score == 0.0
    assert m.roc_auc == 0.5
    assert m.pr_auc == pytest.approx(0.6185185185185185)


def test_random_baseline_prior_and_fixed_auc(spark):
    df = spark.createDataFrame([(i, 1 if i < 309 else 0) for i in range(810)], "id int, label int")
    m = M.random_baseline(df, key="id").first()
    assert m.roc_auc == 0.5
    assert m.pr_auc == pytest.approx(309 / 810)
    assert 0.3 < m.accuracy < 0.7


def test_stratified_split_published_sizes(spark):
    rows = [(f"m{i}", 1 if i < 3088 else 0) for i in range(8091)]
    df = spark.createDataFrame(rows, "smiles string, label int")
    s = split_stratified(df, "label", "smiles", train=0.8, seed=42)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 6472, "val": 809, "test": 810}
    per = {(r["split"], r["label"]): r["count"] for r in s.groupBy("split", "label").count().collect()}
    # strata keep their proportions (largest remainder): 3088 * 1619 / 8091 = 617.9 -> 618
    assert per[("val", 1)] + per[("test", 1)] == 618


def test_split_ratio_085_rounding(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2) for i in range(1000)], "smiles string, label int")
    s = split_stratified(df, "label", "smiles", train=0.85)
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c["val"] + c["test"] == 150  # exact decimal: ceil(1000 * 0.15) = 150, not 151


VAL_LOSS = [0.6550048753327015, 0.6083339522866642, 0.6485193476957434, 0.6877152171789431, 0.6825636935000327]


def test_best_epoch_and_early_stop(spark):
    h = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(VAL_LOSS)], "run_id int, epoch int, val_loss double")
    b = H.best_epoch(h).first()
    assert b.best_epoch == 2
    e = H.early_stop(h, patience=3, min_delta=0.001).first()
    assert e.stop_epoch == 5
    assert e.best_score == pytest.approx(0.6083339522866642)


def test_early_stop_max_mode_and_delta(spark):
    h = spark.createDataFrame([(1, 1, 0.50), (1, 2, 0.5005), (1, 3, 0.52), (1, 4, 0.521), (1, 5, 0.5)],
                              "run_id int, epoch int, val_loss double")
    e = H.early_stop(h, patience=2, min_delta=0.001, mode="max").first()
    # 0.5005 is not > 0.5 + 0.001 (miss 1); 0.52 improves; 0.521 misses (1); 0.5 misses (2) -> stop at 5
    assert e.stop_epoch == 5
    assert e.best_score == pytest.approx(0.52)


def test_improvement_points(spark):
    long = spark.createDataFrame([("pretrained", "accuracy", 0.4419753086419753), ("finetuned", "accuracy", 0.6962962962962963),
                                  ("pretrained", "roc_auc", 0.42944531648676754), ("finetuned", "roc_auc", 0.7081694216744505)],
                                 "model string, metric string, value double")
    imp = {r.metric: r for r in M.improvement(long, "pretrained", "finetuned").collect()}
    assert round(imp["accuracy"].difference_points, 1) == 25.4
    assert round(imp["roc_auc"].difference_points, 1) == 27.9
    wide = spark.createDataFrame([("finetuned", 0.7081694216744505)], "model string, roc_auc double")
    assert M.interpret(wide).first().good_discrimination


def test_mark_best(spark):
    long = spark.createDataFrame([("a", "accuracy", 0.45), ("b", "accuracy", 0.69), ("a", "f1_score", 0.40),
                                  ("b", "f1_score", 0.30)], "model string, metric string, value double")
    marks = {(r.model, r.metric): r.is_best for r in M.mark_best(long).collect()}
    assert marks[("b", "accuracy")] and not marks[("a", "accuracy")]
    assert not marks[("a", "f1_score")]  # best but not > 0.5


def test_roc_auc_and_average_precision_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    r = M.ranking_metrics(df).first()
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(auc)
    # step average precision: sum over distinct thresholds of recall increase x precision
    srt = sorted({s for *_, s in rows}, reverse=True)
    P = len(pos)
    ap, tp, k = 0.0, 0, 0
    for t in srt:
        p = sum(1 for _, y, s in rows if s == t and y == 1)
        n = sum(1 for _, y, s in rows if s == t)
        tp += p
        k += n
        ap += p / P * tp / k
    assert r.pr_auc == pytest.approx(ap)


def test_single_class_auc_is_half(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    r = M.ranking_metrics(df).first()
    assert r.roc_auc == 0.5 and r.pr_auc == 0.5


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3088 + [(0,)] * 5003, "label int")
    w = {r.label: r.weight for r in M.class_weights(df).collect()}
    assert w[1] == pytest.approx(8091 / (2 * 3088))
    assert w[0] == pytest.approx(8091 / (2 * 5003))


def test_keyword_coverage(spark):
    df = spark.createDataFrame([("Approved after safety review of molecular properties", ["approved", "Molecular", "LogP"]),
                                ("x", [])], "response string, kws array<string>")
    kc = M.keyword_coverage("response", "kws")
    r = df.select(kc["keyword_coverage"].alias("c")).collect()
    assert r[0].c == pytest.approx(2 / 3)
    assert r[1].c == 1.0


def test_early_stop_equals_a_plain_fold(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for r in range(30):
        for e in sorted(rnd.sample(range(1, 60), 25)):  # gaps
            rows.append((r if r else None, e, None if rnd.random() < 0.1 else round(rnd.random(), 3)))
    rows += [(77, 1, None), (77, 2, None)]
    h = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double")

    def fold(own, patience, delta):
        best, counter = None, 0
        for e, s in own:
            if best is None:
                best, counter = s, 0
            elif s is not None and s < best - delta:
                best, counter = s, 0
            else:
                counter += 1
                if counter >= patience:
                    return e, best
        return None, best

    for patience, delta in ((0, 0.0), (3, 0.001)):
        got = {r.run_id: (r.stop_epoch, r.best_score) for r in H.early_stop(h, patience, delta).collect()}
        assert got == {r: fold([(e, s) for q, e, s in rows if q == r], patience, delta) for r in {x[0] for x in rows}}


def test_repeated_checkpoints_and_null_losses(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5)], "run_id string, checkpoint int")
    assert sorted((str(r.run_id), r.checkpoint, r.keep) for r in H.retain_latest(runs, 1).collect()) == [
        ("None", 5, True), ("a", 1, False), ("a", 1, False), ("a", 2, True)]
    h = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "run_id int, epoch int, val_loss double")
    assert H.best_epoch(h).first().best_epoch == 1


def test_hooks_take_values(spark):
    from pharmlake.operators import hooks as X

    df = spark.createDataFrame([("abc",), ("xya",), (None,)], "smiles string")
    got = [r.c for r in df.select(X.value_udf(lambda s: s[::-1], "string")("smiles").alias("c")).collect()]
    assert sorted(map(str, got)) == ["None", "ayx", "cba"]
    got = [r.c for r in df.select(X.value_udf(lambda s: s.replace("a", "Z"), "string")("smiles").alias("c")).collect()]
    assert sorted(map(str, got)) == ["None", "Zbc", "xyZ"]


def test_csv_columns_by_header_name(spark, tmp_dir):
    from pharmlake.sources import readers as RD

    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write("chembl_id,name,smiles,status,year\nCHEMBL1,asp,CCO,approved,2001\n")
    with open(f"{tmp_dir}/b.csv", "w") as f:
        f.write("status,smiles,year\nfailed,CCN,unknown\n")
    got = RD.read_csv(spark, [f"{tmp_dir}/a.csv", f"{tmp_dir}/b.csv"], "smiles string, name string, status string, year int")
    assert sorted(map(tuple, got.collect()), key=str) == [("CCN", None, "failed", None), ("CCO", "asp", "approved", 2001)]
    both, bad = RD.read_dir_with_provenance(spark, tmp_dir, types="year int")
    assert not bad and sorted(str(r.year) for r in both.collect()) == ["2001", "None"]


HISTORY = {
    "train_loss": [0.7410238009448105, 0.6554000936126237, 0.5849408001186527, 0.5352485453979341, 0.4717794146909113],
    "val_loss": VAL_LOSS,
    "train_acc": [0.5956427688504327, 0.6611557478368356, 0.7068912237330037, 0.7373300370828183, 0.7753399258343634],
    "val_acc": [0.6711990111248455, 0.6909765142150803, 0.695920889987639, 0.7008652657601978, 0.6761433868974042],
}


def test_history_document_round_trip(spark):
    metrics = list(HISTORY)
    doc = spark.createDataFrame([(1, *[HISTORY[m] for m in metrics])],
                                "run_id int, " + ", ".join(f"{m} array<double>" for m in metrics))
    long = H.history_from_document(doc, metrics)
    assert long.count() == 5
    assert H.best_epoch(long).first().best_epoch == 2
    assert H.early_stop(long, 3, 0.001).first().stop_epoch == 5
    back = H.history_to_document(long, metrics).first()
    assert [list(back[m]) for m in metrics] == [HISTORY[m] for m in metrics]
