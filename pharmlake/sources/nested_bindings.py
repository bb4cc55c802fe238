"""Nested source records over the driver's tables: each binding is one column ``record`` of
JSON text in the shape a source's export has. Absent fields, empty lists, lists that are a
single object and numbers given as text occur, as they do in the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import table


def _every(n: int, k: Column) -> Column:
    return k % n == 0


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields)).alias("record")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    smiles = F.when(_every(13, k), "").when(~_every(11, k), F.concat(F.lit("C"), F.col("p_type")))
    shared = [(k % 14).alias("hba"), (k % 8).alias("hbd"), (k % 13).alias("rtb"), (k % 3).alias("num_ro5_violations"),
              (k % 4).alias("aromatic_rings"), (20 + k % 30).alias("heavy_atoms")]
    numbers = F.to_json(F.struct((100 + k % 400).alias("full_mwt"), (size / 8).alias("alogp"), size.alias("psa"),
                                 (k % 101).alias("qed_weighted"), *shared))
    texts = F.to_json(F.struct(F.when(_every(9, k), "None").otherwise((100 + k % 400).cast("string")).alias("full_mwt"),
                               F.when(~_every(5, k), (size / 8).cast("string")).alias("alogp"),
                               F.when(_every(4, k), "NaN").otherwise(size.cast("string")).alias("psa"),
                               (k % 101).cast("string").alias("qed_weighted"), *shared))
    outer = F.to_json(F.struct(
        F.concat(F.lit("CHEMBL"), k.cast("string")).alias("molecule_chembl_id"), F.when(~_every(7, k), F.col("p_name")).alias("pref_name"),
        F.when(~_every(6, k), (k % 5).cast("string")).alias("max_phase"), (1950 + k % 70).alias("first_approval"),
        F.when(~_every(3, k), _every(2, k)).alias("natural_product"), _every(8, k).alias("withdrawn_flag"),
        F.when(~_every(17, k), F.struct(smiles.alias("canonical_smiles"))).alias("molecule_structures")))
    props = F.when(_every(10, k), F.lit("null")).when(_every(2, k), numbers).otherwise(texts)
    return p.select(F.concat(F.substring(outer, 1, 1), F.lit('"molecule_properties":'), props, F.lit(","),
                             outer.substr(F.lit(2), F.length(outer))).alias("record"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    kinds = F.array(*[F.lit(x) for x in ("IC50", "EC50", "Ki", "Kd", "Potency", "ED50")])
    value = F.when(_every(11, k), "n/a").when(_every(13, k), F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    return li.select(_json(
        F.concat(F.lit("CHEMBL"), part.cast("string")).alias("molecule_chembl_id"),
        F.when(_every(9, part), "").when(~_every(10, part), F.concat(F.lit("C"), (part % 50).cast("string"))).alias("canonical_smiles"),
        F.get(kinds, (line % 6).cast("int")).alias("standard_type"), value.alias("standard_value"),
        F.when(F.col("l_returnflag") == "R", "uM").otherwise("nM").alias("standard_units"),
        F.when(F.col("l_linestatus") == "O", "=").otherwise(">").alias("standard_relation"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("target_chembl_id"),
        F.when(~_every(4, k), F.col("l_returnflag")).alias("target_pref_name"),
        (k * 8 + line).alias("activity_id")))


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(_json(F.concat(F.lit("CHEMBL"), k.cast("string")).alias("molecule_chembl_id"),
                          F.when(~_every(3, k), F.concat(F.lit("T"), (k % 40).cast("string"))).alias("target_chembl_id"),
                          F.col("p_type").alias("mechanism_of_action"), F.when(~_every(5, k), "INHIBITOR").alias("action_type")))


def indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ref = F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.struct(
        F.lit("FDA").alias("ref_type"), F.concat(k.cast("string"), F.lit("/"), i.cast("string")).alias("ref_id")))
    listed = F.when(_every(3, k), F.array().cast("array<struct<ref_type:string,ref_id:string>>")).otherwise(ref)
    one = F.struct(F.lit("ATC").alias("ref_type"), k.cast("string").alias("ref_id"))
    shared = [F.concat(F.lit("CHEMBL"), F.col("o_custkey").cast("string")).alias("molecule_chembl_id"),
              F.when(_every(4, k), "").when(~_every(5, k), F.col("o_orderpriority")).alias("efo_term"),
              F.when(~_every(6, k), F.col("o_orderstatus")).alias("mesh_heading"), (k % 5).alias("max_phase_for_ind")]
    return o.select(F.when(_every(7, k), F.to_json(F.struct(*shared, one.alias("indication_refs"))))
                    .when(_every(8, k), F.to_json(F.struct(*shared)))
                    .otherwise(F.to_json(F.struct(*shared, listed.alias("indication_refs")))).alias("record"))


def metabolism(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(_json(F.concat(F.lit("CHEMBL"), k.cast("string")).alias("drug_chembl_id"),
                          F.when(~_every(3, k), F.col("c_name")).alias("enzyme_name"),
                          F.when(~_every(2, k), F.lit("oxidation")).alias("met_conversion"), F.lit("Homo sapiens").alias("organism")))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    year = F.year("o_orderdate")
    shared = [F.concat(F.lit("CHEMBL"), k.cast("string")).alias("molecule_chembl_id"),
              F.when(~_every(3, k), "Withdrawn").alias("warning_type"), F.col("o_orderpriority").alias("warning_class")]
    return o.select(F.when(_every(5, k), F.to_json(F.struct(*shared, F.lit("unknown").alias("warning_year"))))
                    .when(_every(2, k), F.to_json(F.struct(*shared, year.cast("string").alias("warning_year"))))
                    .otherwise(F.to_json(F.struct(*shared, year.alias("warning_year")))).alias("record"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def upto(n: Column, make) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < n, make(i))), lambda x: x.isNotNull())

    def product(i: Column) -> Column:
        drugs = upto((k + i) % 4, lambda j: F.struct(
            F.concat(F.lit("drug"), ((k + j) % 90).cast("string")).alias("name"), F.when(~_every(3, k + j), F.lit("10MG")).alias("strength")))
        return F.struct(F.concat(F.lit("brand"), i.cast("string")).alias("brand_name"), F.lit("TABLET").alias("dosage_form"),
                        F.when(~_every(2, k + i), "ORAL").alias("route"), drugs.alias("active_ingredients"))

    return o.select(_json(F.concat(F.lit("NDA"), k.cast("string")).alias("application_number"),
                          F.when(~_every(4, k), F.col("o_orderstatus")).alias("sponsor_name"),
                          F.when(~_every(9, k), upto(k % 3, product)).alias("products")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    shared = [k.cast("string").alias("product_ndc"), F.col("p_name").alias("generic_name"),
              F.when(~_every(3, k), F.col("p_brand")).alias("brand_name")]
    routes = F.slice(F.array(F.lit("ORAL"), F.lit("TOPICAL")), 1, (k % 3).cast("int"))
    return p.select(F.when(_every(7, k), F.to_json(F.struct(*shared, F.struct(F.lit(1).alias("x")).alias("route"))))
                    .otherwise(F.to_json(F.struct(*shared, routes.alias("route")))).alias("record"))


def property_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.struct(
        (k * 10 + i).cast("string").alias("CID"), F.when(i != 2, F.col("s_name")).alias("IUPACName"),
        F.concat(F.lit("C"), i.cast("string")).alias("CanonicalSMILES")))
    return n.select(_json(F.when(~_every(5, k), F.struct(rows.alias("Properties"))).alias("PropertyTable")))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    hit = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(
        (k * 2 + i).alias("cid"), F.when(i == 0, F.col("p_name")).alias("iupac_name"),
        F.when(_every(4, k), "unknown").otherwise((k + i).cast("string")).alias("molecular_weight"), (k % 9 + 0.5).alias("xlogp"),
        (k % 7).alias("heavy_atom_count")))
    return p.select(_json(F.col("p_name").alias("query"), F.slice(hit, 1, (k % 3).cast("int")).alias("compounds")))


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = F.transform(F.sequence(F.lit(0), (k % 8).cast("int")), lambda i: F.struct(
        (k * 100 + i).alias("AID"), F.when(i % 3 != 0, F.col("s_name")).alias("SourceName"),
        F.when(i % 2 == 0, "Active").alias("ActivityOutcome")))
    return s.select(_json(k.alias("cid"), F.when(~_every(6, k), F.struct(rows.alias("AssaySummary"))).alias("AssaySummaries")))
