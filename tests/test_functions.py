"""Unit tests for scalar helpers and schema checks."""

import pytest
from pyspark.sql import functions as F

from pharmlake.functions import arrays as A
from pharmlake.functions import text as T
from pharmlake.functions.molecule import valid_alphabet
from pharmlake.operators import clean as C


def test_has_and_require_columns(spark):
    df = spark.createDataFrame([("CCO", 1)], "smiles string, label int")
    assert C.has_columns(df, ["smiles", "label"]) and not C.has_columns(df, ["smiles", "status"])
    assert C.require_columns(df, ["smiles"]) is df
    with pytest.raises(ValueError, match="status"):
        C.require_columns(df, ["smiles", "status"])


def test_fixed_decimal_text(spark):
    df = spark.createDataFrame([(46.068,), (None,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(T.fixed("x", 1)).collect()]
    assert got == ["46.1", "nan", "-0.5"]
    assert df.select(T.signed_fixed("x", 1)).first()[0] == "+46.1"


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \tabc DEF\n", "x" * 120)], "a string, b string")
    r = df.select(T.strip("a").alias("s"), T.capitalise(F.lit("fINETUNED model")).alias("c"),
                  T.shorten("b", 100).alias("t"), T.optional_part(F.lit(""), " ").alias("o"),
                  T.has_word("a", "def").alias("h")).first()
    assert r.s == "abc DEF" and r.c == "Finetuned model" and r.t == "x" * 100 + "..." and r.o == "" and r.h


def test_chatml_and_ensure_chat(spark):
    df = spark.createDataFrame([("Q", "", "A"), ("Q", "ctx", "A")], "i string, n string, o string")
    t = [r[0] for r in df.select(T.chatml("i", "n", "o")).collect()]
    assert t[0] == "<|im_start|>user\nQ\n<|im_end|>\n<|im_start|>assistant\nA\n<|im_end|>"
    assert t[1].startswith("<|im_start|>user\nQ ctx\n")
    w = spark.createDataFrame([("hi",), ("<|im_start|>user\nx",)], "p string").select(T.ensure_chat("p")).collect()
    assert w[0][0] == "<|im_start|>user\nhi\n<|im_end|>\n<|im_start|>assistant\n"
    assert w[1][0] == "<|im_start|>user\nx"


def test_fill_does_not_substitute_twice(spark):
    df = spark.createDataFrame([("{name}", "N")], "smiles string, name string")
    r = df.select(T.fill("S: {smiles} / {name}", smiles="smiles", name="name")).first()[0]
    assert r == "S: {name} / N"


def test_pad_truncate_mask_budget(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    r = df.select(A.pad_truncate("ids", 4, 0).alias("p"), A.attention_mask("ids", 4).alias("m")).collect()
    assert r[0].p == [1, 2, 3, 0] and r[0].m == [1, 1, 1, 0]
    assert r[1].p == [1, 2, 3, 4] and r[1].m == [1, 1, 1, 1]
    t = spark.createDataFrame([("a b c d",)], "t string").select(A.fit_budget("t", 10, 8)).first()[0]
    assert t == "a b"


def test_logit_cleaning_softmax(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), 1.0],)], "x array<double>")
    c = df.select(A.clean_logits("x").alias("c")).first().c
    assert c == [0.0, 100.0, 1.0]
    p = df.select(A.softmax(A.clean_logits("x")).alias("p")).first().p
    assert sum(p) == pytest.approx(1.0) and p.index(max(p)) == 1


def test_alphabet_rejects_h_and_dot(spark):
    df = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O",), ("NC[C@H](N)O",), ("C.C",), ("ClBr",)], "s string")
    assert [r[0] for r in df.select(valid_alphabet("s")).collect()] == [True, False, False, True]
