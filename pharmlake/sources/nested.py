"""Nested source records to flat rows.

Records arrive as JSON whose fields come and go and change type between exports (a number
as text, an object where a list was). They are read as VARIANT and every declared leaf is
taken from it on its own (``records``, ``read_records``), so a field that does not fit its
declared type is null and costs neither the record nor its neighbours. The flattening below
works on the typed rows: struct field access, ``explode`` of arrays, ``try_cast`` of
numbers given as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# Declared input schemas (JSON records as landed).
PROPS = ("full_mwt string, alogp string, hba int, hbd int, psa string, rtb int, num_ro5_violations int, "
         "aromatic_rings int, heavy_atoms int, qed_weighted string")
MOLECULE_SCHEMA = (f"molecule_chembl_id string, pref_name string, max_phase int, first_approval int, "
                   f"molecule_type string, therapeutic_flag boolean, natural_product boolean, withdrawn_flag boolean, "
                   f"prodrug boolean, molecule_structures struct<canonical_smiles: string>, "
                   f"molecule_properties struct<{PROPS}>")
ACTIVITY_SCHEMA = ("molecule_chembl_id string, canonical_smiles string, standard_type string, standard_value string, "
                   "standard_units string, standard_relation string, target_chembl_id string, target_pref_name string, "
                   "assay_type string, activity_id long")
MECHANISM_SCHEMA = ("molecule_chembl_id string, target_chembl_id string, mechanism_of_action string, action_type string, "
                    "target_pref_name string, mechanism_comment string")
INDICATION_SCHEMA = ("molecule_chembl_id string, efo_term string, mesh_heading string, max_phase_for_ind int, "
                     "indication_refs array<struct<ref_type: string, ref_id: string, ref_url: string>>")
METABOLISM_SCHEMA = ("drug_chembl_id string, metabolite_chembl_id string, enzyme_name string, met_conversion string, "
                     "organism string")
WARNING_SCHEMA = ("molecule_chembl_id string, warning_type string, warning_class string, warning_description string, "
                  "warning_country string, warning_year int, efo_term string")
DRUGSFDA_SCHEMA = ("application_number string, sponsor_name string, products array<struct<brand_name: string, "
                   "dosage_form: string, route: string, marketing_status: string, "
                   "active_ingredients: array<struct<name: string, strength: string>>>>")
NDC_SCHEMA = ("product_ndc string, generic_name string, brand_name string, labeler_name string, dosage_form string, "
              "route array<string>, product_type string, marketing_category string")
PUBCHEM_TABLE_SCHEMA = "PropertyTable struct<Properties: array<struct<CID: long, IUPACName: string, CanonicalSMILES: string>>>"
PUBCHEM_COMPOUND_SCHEMA = ("query string, compounds array<struct<cid: long, iupac_name: string, molecular_formula: string, "
                           "molecular_weight: string, xlogp: double, tpsa: double, h_bond_donor_count: int, "
                           "h_bond_acceptor_count: int, rotatable_bond_count: int, heavy_atom_count: int, "
                           "complexity: double, exact_mass: string>>")
ASSAY_SCHEMA = ("cid long, AssaySummaries struct<AssaySummary: array<struct<AID: long, SourceName: string, "
                "ActivityOutcome: string, TargetName: string>>>")


def typed(v: Column, kind: DataType) -> Column:
    """A variant as a declared type, leaf by leaf: what does not fit is null there. A single
    object where a list is declared counts as a list of one."""
    if isinstance(kind, StructType):
        fields = [typed(F.try_variant_get(v, f"$.{f.name}", "variant"), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(*fields))
    if isinstance(kind, ArrayType):
        listed = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)) \
            .otherwise(F.try_variant_get(v, "$", "array<variant>"))
        return F.transform(listed, lambda x: typed(x, kind.elementType))
    leaf = F.try_variant_get(v, "$", kind.simpleString())
    return F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), leaf) if kind.simpleString() == "string" else leaf


def _shape(kind: DataType) -> str:
    """The type a record is cast to at once: the declared one, with lists left as variants."""
    if isinstance(kind, StructType):
        return "struct<" + ", ".join(f"`{f.name}`: {_shape(f.dataType)}" for f in kind.fields) + ">"
    return "variant" if isinstance(kind, ArrayType) else kind.simpleString()


def _leaf(r: Column, v: Column, path: str, kind: DataType) -> Column:
    """``typed`` of the record ``v`` at ``path``, from its value ``r`` in the cast record. The
    cast gives objects and lists as JSON text where a string is declared; only text that
    begins like one is looked up again."""
    if isinstance(kind, StructType):
        fields = [_leaf(r.getField(f.name), v, f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields]
        return F.when(r.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return typed(r, kind)
    if kind.simpleString() != "string":
        return r
    nested = F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(OBJECT|ARRAY)")
    return F.when(r.startswith("{") | r.startswith("["), F.when(~nested, r)).otherwise(r)


def records(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Typed rows of a column of JSON text (or variants), one per record. Text that is not
    JSON and records that are no objects are left out."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    v = F.col(column) if dict(df.dtypes)[column] == "variant" else F.try_parse_json(F.col(column))
    # Each explode keeps later filters above it: pushed below, each of their terms would
    # build, parse and cast the record again.
    rows = df.select(F.explode(F.array(v)).alias("__v"))
    rows = rows.select("__v", F.explode(F.array(F.try_variant_get("__v", "$", _shape(st)))).alias("__r")).where("__r is not null")
    return rows.select(*[_leaf(F.col("__r").getField(f.name), F.col("__v"), f"$.{f.name}", f.dataType).alias(f.name)
                         for f in st.fields])


def read_records(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """Typed rows of landed JSON files, one record a line (or one document a file)."""
    raw = spark.read.option("singleVariantColumn", "record").option("multiLine", str(multi_line).lower()).json(path)
    return records(raw, "record", schema)


def _num(c: Column) -> Column:
    """Number given as text (or number): NaN and non-numeric text become NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def _s(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def flatten_molecules(df: DataFrame, status: str, default_phase: int | None = None) -> DataFrame:
    """Molecule record to a flat row; rows without a non-empty canonical SMILES are
    dropped; a missing property struct gives null properties."""
    smiles = F.col("molecule_structures.canonical_smiles")
    p = "molecule_properties."
    phase = F.col("max_phase") if default_phase is None else F.coalesce(F.col("max_phase"), F.lit(default_phase))
    out = df.where(smiles.isNotNull() & (smiles != "")).select(
        F.col("molecule_chembl_id").alias("chembl_id"), _s("pref_name").alias("name"), smiles.alias("smiles"),
        phase.alias("max_phase"), F.col("first_approval"),
        _num(F.col(p + "full_mwt")).alias("molecular_weight"), _num(F.col(p + "alogp")).alias("alogp"),
        F.col(p + "hba").alias("hba"), F.col(p + "hbd").alias("hbd"), _num(F.col(p + "psa")).alias("psa"),
        F.lit(status).alias("status"))
    return out


def flatten_compounds(df: DataFrame) -> DataFrame:
    """Detailed compound row; ``ro5_compliant`` = (violations = 0), null when unknown."""
    smiles = F.col("molecule_structures.canonical_smiles")
    p = "molecule_properties."
    v = F.col(p + "num_ro5_violations")
    return df.where(smiles.isNotNull() & (smiles != "")).select(
        F.col("molecule_chembl_id").alias("chembl_id"), _s("pref_name").alias("name"), smiles.alias("smiles"),
        F.coalesce(F.col("max_phase"), F.lit(0)).alias("max_phase"), F.col("first_approval"),
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("therapeutic_flag", "natural_product",
                                                                "withdrawn_flag", "prodrug")],
        _num(F.col(p + "full_mwt")).alias("molecular_weight"), _num(F.col(p + "alogp")).alias("alogp"),
        F.col(p + "hba").alias("hba"), F.col(p + "hbd").alias("hbd"), _num(F.col(p + "psa")).alias("psa"),
        F.col(p + "rtb").alias("rtb"), v.alias("num_ro5_violations"), F.col(p + "aromatic_rings").alias("aromatic_rings"),
        F.col(p + "heavy_atoms").alias("heavy_atoms"), _num(F.col(p + "qed_weighted")).alias("qed_weighted"),
        (v == 0).alias("ro5_compliant"))


BIOACTIVITY_TYPES = ["IC50", "EC50", "Ki", "Kd"]


def bioactivity(df: DataFrame, limit: int | None = None, order: str = "activity_id") -> DataFrame:
    """Measured activities: type in (IC50, EC50, Ki, Kd), unit nM, relation '=',
    structure and a numeric value present (a non-numeric value drops the row)."""
    val = _num(F.col("standard_value"))
    out = df.where(F.col("standard_type").isin(*BIOACTIVITY_TYPES) & (F.col("standard_units") == "nM")
                   & (F.col("standard_relation") == "=") & F.col("canonical_smiles").isNotNull()
                   & (F.col("canonical_smiles") != "") & val.isNotNull()) \
        .select(F.col("molecule_chembl_id").alias("chembl_id"), F.col("canonical_smiles").alias("smiles"),
                F.col("standard_type").alias("activity_type"), val.alias("activity_value"),
                F.col("standard_units").alias("activity_units"), _s("target_chembl_id").alias("target_id"),
                _s("target_pref_name").alias("target_name"), _s("assay_type").alias("assay_type"), F.col(order))
    if limit is not None:
        out = out.orderBy(order).limit(limit)
    return out.drop(order)


def flatten_mechanisms(df: DataFrame) -> DataFrame:
    """Absent field = ''."""
    return df.select(_s("molecule_chembl_id").alias("chembl_id"), _s("target_chembl_id").alias("target_chembl_id"),
                     _s("mechanism_of_action").alias("mechanism_of_action"), _s("action_type").alias("action_type"),
                     _s("target_pref_name").alias("target_name"), _s("mechanism_comment").alias("mechanism_comment"))


def flatten_indications(df: DataFrame) -> DataFrame:
    """First non-empty of the two terms; the reference list is kept as an array."""
    term = F.coalesce(F.nullif(F.col("efo_term"), F.lit("")), F.nullif(F.col("mesh_heading"), F.lit("")), F.lit(""))
    return df.select(_s("molecule_chembl_id").alias("chembl_id"), term.alias("indication"),
                     F.col("max_phase_for_ind").alias("max_phase"),
                     F.coalesce(F.col("indication_refs"), F.array().cast(df.schema["indication_refs"].dataType))
                     .alias("indication_refs"))


def flatten_metabolism(df: DataFrame) -> DataFrame:
    """S10."""
    return df.select(*[_s(c).alias(c) for c in ("drug_chembl_id", "metabolite_chembl_id", "enzyme_name",
                                                  "met_conversion", "organism")])


def flatten_warnings(df: DataFrame) -> DataFrame:
    """S11."""
    return df.select(_s("molecule_chembl_id").alias("chembl_id"),
                     *[_s(c).alias(c) for c in ("warning_type", "warning_class", "warning_description",
                                                "warning_country")],
                     F.col("warning_year"), _s("efo_term").alias("efo_term"))


def flatten_drugsfda(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Application -> product -> ingredient, one row per ingredient; an empty
    product or ingredient list drops its parent (inner explode)."""
    prod = df.select("application_number", "sponsor_name", F.explode("products").alias("p"))
    ing = prod.select("application_number", "sponsor_name", "p", F.explode("p.active_ingredients").alias("i"))
    out = ing.select(_s("application_number").alias("application_number"),
                     F.coalesce(F.col("p.brand_name"), F.lit("")).alias("brand_name"),
                     F.coalesce(F.col("i.name"), F.lit("")).alias("generic_name"),
                     F.coalesce(F.col("p.dosage_form"), F.lit("")).alias("dosage_form"),
                     F.coalesce(F.col("p.route"), F.lit("")).alias("route"),
                     F.coalesce(F.col("i.strength"), F.lit("")).alias("strength"),
                     F.coalesce(F.col("p.marketing_status"), F.lit("")).alias("marketing_status"),
                     _s("sponsor_name").alias("sponsor_name"), F.lit("approved").alias("status"))
    if limit is not None:
        out = out.orderBy("application_number", "brand_name", "generic_name").limit(limit)
    return out


def flatten_ndc(df: DataFrame) -> DataFrame:
    """route = first element of the route list, else ''."""
    return df.select(*[_s(c).alias(c) for c in ("product_ndc", "generic_name", "brand_name", "labeler_name",
                                                  "dosage_form")],
                     F.coalesce(F.try_element_at("route", F.lit(1)), F.lit("")).alias("route"),
                     _s("product_type").alias("product_type"), _s("marketing_category").alias("marketing_category"),
                     F.lit("approved").alias("status"))


def flatten_pubchem(df: DataFrame) -> DataFrame:
    """Property table to one row per compound."""
    rows = df.select(F.explode("PropertyTable.Properties").alias("p"))
    return rows.select(F.col("p.CID").alias("pubchem_cid"), F.coalesce(F.col("p.IUPACName"), F.lit("")).alias("name"),
                       F.coalesce(F.col("p.CanonicalSMILES"), F.lit("")).alias("smiles"), F.lit("approved").alias("status"))


def first_property_match(df: DataFrame) -> DataFrame:
    """First match per query, twelve property fields; no match gives no row."""
    first = df.where(F.size("compounds") > 0).select("query", F.element_at("compounds", 1).alias("c"))
    return first.select("query", F.col("c.cid").alias("pubchem_cid"), "c.iupac_name", "c.molecular_formula",
                        _num(F.col("c.molecular_weight")).alias("molecular_weight"), "c.xlogp", "c.tpsa",
                        "c.h_bond_donor_count", "c.h_bond_acceptor_count", "c.rotatable_bond_count",
                        "c.heavy_atom_count", "c.complexity", _num(F.col("c.exact_mass")).alias("exact_mass"))


def flatten_assays(df: DataFrame, n: int | None = None) -> DataFrame:
    """The assays of each compound in listed order, the first n if n is given."""
    listed = F.col("AssaySummaries.AssaySummary")
    a = df.select("cid", F.explode(listed if n is None else F.slice(listed, 1, n)).alias("a"))
    return a.select("cid", F.col("a.AID").alias("assay_id"), F.coalesce(F.col("a.SourceName"), F.lit("")).alias("assay_name"),
                    F.coalesce(F.col("a.ActivityOutcome"), F.lit("")).alias("activity_outcome"),
                    F.coalesce(F.col("a.TargetName"), F.lit("")).alias("target_name"))


def batch_keys(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """Keys in batches of n (global key order), each batch joined with commas."""
    from ..operators.ranking import row_number_by_key

    r = row_number_by_key(df.select(key), key, "__rn")
    g = r.groupBy(F.floor((F.col("__rn") - 1) / n).cast("bigint").alias("batch")).agg(
        F.array_sort(F.collect_list(key)).alias("__ks"))
    return g.select("batch", F.array_join(F.transform("__ks", lambda x: x.cast("string")), ",").alias("keys"),
                    F.size("__ks").alias("n"))
