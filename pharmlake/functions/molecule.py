"""Molecule validity as column expressions (no toolkit: length and alphabet)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import SMILES_ALPHABET

# Character class of the alphabet; every character escaped so the class is literal.
ALPHABET_REGEX = "^[" + "".join(re.escape(ch) if ch in "[]\\-^" else ch for ch in dict.fromkeys(SMILES_ALPHABET)) + "]*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """V3/P5: non-null and non-empty (false, never null)."""
    x = _c(c)
    return F.coalesce(x.isNotNull() & (x != F.lit("")), F.lit(False))


def valid_length(c: Column | str, lo: int, hi: int) -> Column:
    """V1: length within [lo, hi]; missing or empty is invalid."""
    x = _c(c)
    return present(x) & F.coalesce(F.length(x).between(lo, hi), F.lit(False))


def valid_alphabet(c: Column | str) -> Column:
    """V2: only characters of the accepted SMILES alphabet; missing or empty is invalid."""
    x = _c(c)
    return present(x) & F.coalesce(x.rlike(ALPHABET_REGEX), F.lit(False))


def valid_smiles(c: Column | str, lo: int = 1, hi: int = 10_000) -> Column:
    """V1-V3 together (the built-in path used when no toolkit hook is given)."""
    return valid_length(c, lo, hi) & valid_alphabet(c)
