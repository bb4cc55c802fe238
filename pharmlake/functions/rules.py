"""Domain rules as column expressions.

NULL rule: a missing number takes the else branch of every test (as NaN does in the
reference). Every rule is written ``when(test, good).otherwise(bad)``; no test on a
nullable column is negated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    FAILED_STATUSES,
    OUTCOME_APPROVED,
    OUTCOME_DEVELOPMENT,
    OUTCOME_FAILED,
    OUTCOME_UNLIKELY,
    ROUTE_CARDIO,
    ROUTE_EFFICACY,
    ROUTE_HEPATO,
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(name: str) -> Column:
    """A numeric column whose NaN counts as missing (Spark orders NaN above every number)."""
    return F.when(~F.isnan(F.col(name)), F.col(name))


def flag(test: Column) -> Column:
    """A test as a non-null boolean (NULL -> False)."""
    return F.when(test, F.lit(True)).otherwise(F.lit(False))


def is_status(status: Column | str, *values: str) -> Column:
    return flag(_c(status).isin(*values))


# ---- M1 outcome ---------------------------------------------------------------
def outcome(status: Column | str = "status", max_phase: Column | str = "max_phase") -> Column:
    """M1: APPROVED / FAILED/WITHDRAWN / IN DEVELOPMENT / UNLIKELY TO SUCCEED."""
    s, ph = _c(status), _c(max_phase)
    return (F.when((s == "approved") | (ph == 4), OUTCOME_APPROVED[0])
            .when(s.isin(*FAILED_STATUSES), OUTCOME_FAILED[0])
            .when(ph >= 2, OUTCOME_DEVELOPMENT[0])
            .otherwise(OUTCOME_UNLIKELY[0]))


def confidence(status: Column | str = "status", max_phase: Column | str = "max_phase") -> Column:
    s, ph = _c(status), _c(max_phase)
    return F.when((s == "approved") | (ph == 4) | s.isin(*FAILED_STATUSES), "High").otherwise("Medium")


# ---- M2 property flags (strict limits) ----------------------------------------
def property_flags() -> dict[str, Column]:
    """M2: six flags, True when the property is within its limit."""
    return {
        "mw_ok": flag(_num("molecular_weight") < 500),
        "logp_ok": flag(_num("alogp") < 5),
        "hba_ok": flag(F.col("hba") <= 10),
        "hbd_ok": flag(F.col("hbd") <= 5),
        "psa_ok": flag(_num("psa") <= 140),
        "ro5_ok": flag(F.col("num_ro5_violations") == 0),
    }


# ---- M3 drug-likeness tier ----------------------------------------------------
def likeness_tier() -> Column:
    v, mw, lp = F.col("num_ro5_violations"), _num("molecular_weight"), _num("alogp")
    return (F.when((v == 0) & (mw < 500) & (lp < 5), "excellent")
            .when(v <= 1, "acceptable").otherwise("poor"))


# ---- M4 status section --------------------------------------------------------
def status_section(status: Column | str = "status") -> Column:
    s = _c(status)
    return F.when(s.isin(*FAILED_STATUSES), "failure").when(s == "approved", "success").otherwise("none")


# ---- M6 failure category routing ---------------------------------------------
def _any_contains(text: Column, words: list[str]) -> Column:
    t = F.lower(text)
    out = None
    for w in words:
        e = t.contains(w)
        out = e if out is None else (out | e)
    return out


def failure_route(category: Column | str = "failure_category") -> Column:
    """M6: first match of cardio/cardiac, hepato/liver, efficacy; else other."""
    c = _c(category)
    return (F.when(_any_contains(c, ROUTE_CARDIO), "cardio")
            .when(_any_contains(c, ROUTE_HEPATO), "hepato")
            .when(_any_contains(c, ROUTE_EFFICACY), "efficacy")
            .otherwise("other"))


# ---- M8 / M9 head-to-head -----------------------------------------------------
def head_to_head(prefix1: str = "d1_", prefix2: str = "d2_") -> dict[str, Column]:
    """M8: winner per property, 1 or 2 (ties and missing go to the second); status
    winner 0 when neither is approved."""
    a = lambda n: F.col(prefix1 + n)
    b = lambda n: F.col(prefix2 + n)
    return {
        "status_winner": F.when(a("status") == "approved", 1).when(b("status") == "approved", 2).otherwise(0),
        "weight_winner": F.when(a("molecular_weight") < b("molecular_weight"), 1).otherwise(2),
        "logp_winner": F.when(F.abs(a("alogp") - 2) < F.abs(b("alogp") - 2), 1).otherwise(2),
        "psa_winner": F.when(a("psa") < b("psa"), 1).otherwise(2),
    }


def oral_outlook(mw: Column, logp: Column) -> Column:
    return F.when((mw < 500) & (logp < 5), "better").otherwise("challenging")


def verdict(prefix1: str = "d1_", prefix2: str = "d2_") -> Column:
    """M9: 'first' / 'second' when exactly one is approved, else 'similar'."""
    ap1 = F.coalesce(F.col(prefix1 + "status") == "approved", F.lit(False))
    ap2 = F.coalesce(F.col(prefix2 + "status") == "approved", F.lit(False))
    return F.when(ap1 & ~ap2, "first").when(ap2 & ~ap1, "second").otherwise("similar")


# ---- M11-M14 ranges, ADMET, Lipinski, Veber ----------------------------------
def range_flags() -> dict[str, Column]:
    mw, lp = _num("molecular_weight"), _num("alogp")
    return {
        "mw_in_range": flag((mw >= 150) & (mw <= 500)),
        "logp_in_range": flag((lp >= 0) & (lp <= 5)),
        "hba_in_range": flag(F.col("hba") <= 10),
        "hbd_in_range": flag(F.col("hbd") <= 5),
        "psa_in_range": flag(_num("psa") < 140),
        "rtb_in_range": flag(F.col("rtb") <= 10),
    }


def admet_rules() -> dict[str, Column]:
    mw, lp, psa = _num("molecular_weight"), _num("alogp"), _num("psa")
    return {
        "good_absorption": flag((psa < 140) & (lp < 5)),
        "cns_penetrant": flag((psa < 90) & (lp > 1) & (lp < 5)),
        "high_binding": flag(lp > 3),
        "volume": F.when(lp > 3, "high").when(lp > 1, "moderate").otherwise("low"),
        "cyp_substrate": flag((mw > 300) & (lp > 1)),
        "cyp_inhibition": flag(lp > 4),
        "hepatic_clearance": flag(lp > 1),
        "long_half_life": flag((mw > 400) & (lp > 3)),
    }


def lipinski() -> Column:
    """Inclusive limits (unlike M2)."""
    return flag((_num("molecular_weight") <= 500) & (_num("alogp") <= 5)
                & (F.col("hbd") <= 5) & (F.col("hba") <= 10))


def veber() -> Column:
    return flag((F.col("rtb") <= 10) & (_num("psa") < 140))
