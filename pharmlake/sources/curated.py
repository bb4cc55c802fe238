"""Curated literal tables. The library ships their schemas, not their rows:
users land the tables as CSV/JSON and read them with a declared schema. Sentinel
structures (P6) are dropped on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import SENTINEL_NAMES
from .readers import read_csv

SCHEMAS = {
    "failed_drugs": "name string, smiles string, reason string, year int, phase_failed string, status string",
    "novel_alternatives": "name string, smiles string, original_drug string, improvement string, status string",
    "curated_drugs": "name string, smiles string, status string",
    "clinical_trial_failures": ("name string, smiles string, phase_failed string, failure_reason string, "
                                "failure_category string, therapeutic_area string, year int, company string, "
                                "additional_info string"),
    "drug_withdrawals": ("name string, smiles string, withdrawal_year int, withdrawal_regions array<string>, "
                         "primary_reason string, detailed_reason string, mechanism string, affected_population string, "
                         "estimated_deaths string"),
}


def load_curated(spark: SparkSession, path: str, name: str, fmt: str = "json") -> DataFrame:
    """Read a landed curated table with its declared schema; sentinel SMILES dropped."""
    schema = SCHEMAS[name]
    df = spark.read.schema(schema).json(path) if fmt == "json" else read_csv(spark, path, schema)
    return df.where(~F.coalesce(F.col("smiles").isin(*SENTINEL_NAMES), F.lit(False)))
