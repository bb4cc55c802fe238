"""Queries that once took the first rows only: they read all rows, as their SQL twins do
(the values are compared in test_oracle)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pharmlake.sources import bindings as B

SF = "/root/testdata/sf0.01"


def test_no_row_limits_in_the_twins():
    for name in ("pair_by_rank", "head_to_head", "comparison_reports", "instruction_samples", "instruction_task_counts",
                 "instruction_splits", "instruction_texts"):
        assert " limit " not in E.oracle_sql()[name]


def test_pairs_reach_the_shorter_side(spark):
    c = B.compounds(spark, SF)
    shorter = min(c.where("status = 'approved'").count(), c.where("status in ('failed', 'withdrawn')").count())
    assert shorter > 200 and E.queries()["pair_by_rank"](spark, SF).count() == shorter


@pytest.mark.parametrize("task,above", [("improvement_suggestion", 500), ("comparison", 200)])
def test_branches_pass_their_old_limits(spark, task, above):
    counts = E.queries()["instruction_task_counts"](spark, SF).where(F.col("task_type") == task).first()
    assert counts["count"] > above


def test_property_branch_takes_every_weighed_compound(spark):
    """Fewer than the old limit of 1000 here, so the rows are counted."""
    from pharmlake.plans.instruct_set import combined

    weighed = combined(B.compounds(spark, SF), B.failures(spark, SF)).where("molecular_weight is not null").count()
    counts = E.queries()["instruction_task_counts"](spark, SF).where("task_type = 'property_analysis'").first()
    assert counts["count"] == weighed


def test_whole_strings_become_tokens(spark):
    r = E.queries()["char_token_ids"](spark, SF).agg(F.max("n_tokens").alias("most")).first()
    assert r.most <= 512  # the model's length: nothing is cut
