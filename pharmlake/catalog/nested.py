"""Queries over nested source records (S5-S13, S15-S17): JSON records, read as VARIANT,
flattened. The twins compute the flat rows from the tables the records were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import nested as N
from ..sources import nested_bindings as B
from . import register


def rows(binding, schema):
    def read(spark, d):
        return N.records(binding(spark, d), "record", schema)

    return read


molecules = rows(B.molecules, N.MOLECULE_SCHEMA)
MOLECULE_SQL = """WITH m AS (select *, p_partkey k, p_partkey % 10 = 0 as bare, p_partkey % 2 = 0 as numeric from part
  where p_partkey % 17 <> 0 and p_partkey % 13 <> 0 and p_partkey % 11 <> 0),
f AS (select k, 'CHEMBL' || k as chembl_id, case when k % 7 = 0 then '' else p_name end as name, 'C' || p_type as smiles,
  case when k % 6 <> 0 then cast(k % 5 as int) end as phase, cast(1950 + k % 70 as int) as first_approval,
  case when bare then null when numeric or k % 9 <> 0 then cast(100 + k % 400 as double) end as molecular_weight,
  case when bare then null when numeric or k % 5 <> 0 then cast(p_size as double) / 8 end as alogp,
  case when not bare then cast(k % 14 as int) end as hba, case when not bare then cast(k % 8 as int) end as hbd,
  case when bare then null when numeric or k % 4 <> 0 then cast(p_size as double) end as psa,
  case when not bare then cast(k % 13 as int) end as rtb, case when not bare then cast(k % 3 as int) end as num_ro5_violations,
  case when not bare then cast(k % 4 as int) end as aromatic_rings, case when not bare then cast(20 + k % 30 as int) end as heavy_atoms,
  case when not bare then cast(k % 101 as double) end as qed_weighted,
  k % 3 <> 0 and k % 2 = 0 as natural_product, k % 8 = 0 as withdrawn_flag from m)
"""


@register("nested_molecules", MOLECULE_SQL + """select chembl_id, name, smiles, coalesce(phase, 4) as max_phase, first_approval,
  molecular_weight, alogp, hba, hbd, psa, 'approved' as status from f""")
def nested_molecules(spark, d):
    return N.flatten_molecules(molecules(spark, d), "approved", 4)


@register("nested_compounds", MOLECULE_SQL + """select chembl_id, name, smiles, coalesce(phase, 0) as max_phase, first_approval,
  false as therapeutic_flag, natural_product, withdrawn_flag, false as prodrug, molecular_weight, alogp, hba, hbd, psa, rtb,
  num_ro5_violations, aromatic_rings, heavy_atoms, qed_weighted, num_ro5_violations = 0 as ro5_compliant from f""")
def nested_compounds(spark, d):
    return N.flatten_compounds(molecules(spark, d))


@register("nested_activities", """select 'CHEMBL' || l_partkey as chembl_id, 'C' || (l_partkey % 50) as smiles,
  ['IC50', 'EC50', 'Ki', 'Kd'][l_linenumber % 6 + 1] as activity_type, cast(l_quantity as double) as activity_value,
  'nM' as activity_units, 'T' || l_suppkey as target_id, case when l_orderkey % 4 = 0 then '' else l_returnflag end as target_name, '' as assay_type
from lineitem where l_linenumber % 6 < 4 and l_returnflag <> 'R' and l_linestatus = 'O' and l_partkey % 9 <> 0 and l_partkey % 10 <> 0
  and l_orderkey % 11 <> 0 and l_orderkey % 13 <> 0""")
def nested_activities(spark, d):
    return N.bioactivity(rows(B.activities, N.ACTIVITY_SCHEMA)(spark, d))


@register("nested_mechanisms", """select 'CHEMBL' || p_partkey as chembl_id, case when p_partkey % 3 = 0 then '' else 'T' || (p_partkey % 40) end as target_chembl_id,
  p_type as mechanism_of_action, case when p_partkey % 5 = 0 then '' else 'INHIBITOR' end as action_type, '' as target_name,
  '' as mechanism_comment from part""")
def nested_mechanisms(spark, d):
    return N.flatten_mechanisms(rows(B.mechanisms, N.MECHANISM_SCHEMA)(spark, d))


@register("nested_indications", """select 'CHEMBL' || o_custkey as chembl_id,
  case when o_orderkey % 4 <> 0 and o_orderkey % 5 <> 0 then o_orderpriority when o_orderkey % 6 <> 0 then o_orderstatus else '' end as indication,
  cast(o_orderkey % 5 as int) as max_phase,
  cast(case when o_orderkey % 7 = 0 then 1 when o_orderkey % 8 = 0 then 0 else o_orderkey % 3 end as int) as n_refs,
  case when o_orderkey % 7 = 0 then cast(o_orderkey as varchar) when o_orderkey % 8 <> 0 and o_orderkey % 3 > 0 then o_orderkey || '/1' end as first_ref
from orders""")
def nested_indications(spark, d):
    out = N.flatten_indications(rows(B.indications, N.INDICATION_SCHEMA)(spark, d))
    return out.select("chembl_id", "indication", "max_phase", F.size("indication_refs").alias("n_refs"),
                      F.get("indication_refs", F.lit(0))["ref_id"].alias("first_ref"))


@register("nested_metabolism", """select 'CHEMBL' || c_custkey as drug_chembl_id, '' as metabolite_chembl_id,
  case when c_custkey % 3 = 0 then '' else c_name end as enzyme_name, case when c_custkey % 2 = 0 then '' else 'oxidation' end as met_conversion,
  'Homo sapiens' as organism from customer""")
def nested_metabolism(spark, d):
    return N.flatten_metabolism(rows(B.metabolism, N.METABOLISM_SCHEMA)(spark, d))


@register("nested_warnings", """select 'CHEMBL' || o_orderkey as chembl_id, case when o_orderkey % 3 = 0 then '' else 'Withdrawn' end as warning_type,
  o_orderpriority as warning_class, '' as warning_description, '' as warning_country,
  case when o_orderkey % 5 <> 0 then cast(year(o_orderdate) as int) end as warning_year, '' as efo_term from orders""")
def nested_warnings(spark, d):
    return N.flatten_warnings(rows(B.warnings, N.WARNING_SCHEMA)(spark, d))


@register("nested_applications", """WITH p AS (select o_orderkey k, o_orderstatus, unnest(range(o_orderkey % 3)) i from orders where o_orderkey % 9 <> 0),
g AS (select k, o_orderstatus, i, unnest(range((k + i) % 4)) j from p)
select 'NDA' || k as application_number, 'brand' || i as brand_name, 'drug' || ((k + j) % 90) as generic_name, 'TABLET' as dosage_form,
  case when (k + i) % 2 = 0 then '' else 'ORAL' end as route, case when (k + j) % 3 = 0 then '' else '10MG' end as strength,
  '' as marketing_status, case when k % 4 = 0 then '' else o_orderstatus end as sponsor_name, 'approved' as status from g""")
def nested_applications(spark, d):
    return N.flatten_drugsfda(rows(B.applications, N.DRUGSFDA_SCHEMA)(spark, d))


@register("nested_products", """select cast(p_partkey as varchar) as product_ndc, p_name as generic_name,
  case when p_partkey % 3 = 0 then '' else p_brand end as brand_name, '' as labeler_name, '' as dosage_form,
  case when p_partkey % 7 = 0 or p_partkey % 3 = 0 then '' else 'ORAL' end as route, '' as product_type, '' as marketing_category,
  'approved' as status from part""")
def nested_products(spark, d):
    return N.flatten_ndc(rows(B.products, N.NDC_SCHEMA)(spark, d))


@register("nested_property_tables", """WITH p AS (select s_suppkey k, s_name, unnest(range(1, 2 + s_suppkey % 3)) i from supplier where s_suppkey % 5 <> 0)
select k * 10 + i as pubchem_cid, case when i = 2 then '' else s_name end as name, 'C' || i as smiles, 'approved' as status from p""")
def nested_property_tables(spark, d):
    return N.flatten_pubchem(rows(B.property_tables, N.PUBCHEM_TABLE_SCHEMA)(spark, d))


@register("nested_first_matches", """select p_name as query, p_partkey * 2 as pubchem_cid, p_name as iupac_name, cast(null as varchar) as molecular_formula,
  case when p_partkey % 4 <> 0 then cast(p_partkey as double) end as molecular_weight, p_partkey % 9 + 0.5::double as xlogp,
  cast(null as double) as tpsa, cast(null as int) as h_bond_donor_count, cast(null as int) as h_bond_acceptor_count,
  cast(null as int) as rotatable_bond_count, cast(p_partkey % 7 as int) as heavy_atom_count, cast(null as double) as complexity,
  cast(null as double) as exact_mass from part where p_partkey % 3 <> 0""")
def nested_first_matches(spark, d):
    return N.first_property_match(rows(B.lookups, N.PUBCHEM_COMPOUND_SCHEMA)(spark, d))


@register("nested_assays", """WITH a AS (select s_suppkey k, s_name, unnest(range(least(s_suppkey % 8 + 1, 5))) i from supplier where s_suppkey % 6 <> 0)
select k as cid, k * 100 + i as assay_id, case when i % 3 = 0 then '' else s_name end as assay_name,
  case when i % 2 = 0 then 'Active' else '' end as activity_outcome, '' as target_name from a""")
def nested_assays(spark, d):
    return N.flatten_assays(rows(B.assays, N.ASSAY_SCHEMA)(spark, d), 5)
