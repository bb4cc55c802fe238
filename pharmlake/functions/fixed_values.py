"""Fixed values.

These strings, character sets and limits must equal the reference's for the
produced text and rule columns to be the same. They are stated as plain text in
their natural order; nothing else in the library copies them.
"""

# ---------------------------------------------------------------- FIXED VALUES ---
# SMILES alphabet accepted without a chemistry toolkit.
SMILES_ALPHABET = "CNOSPFClBrI[]()=#+-0123456789@/\\cnops"

# Source rank for keep-first deduplication (load order of the unified table).
SOURCE_ORDER = ["chembl", "drugbank", "fda_failed", "fda_novel"]

# Status -> class label (unknown -> 0).
LABEL_MAP = {"approved": 1, "failed": 0, "withdrawn": 0, "experimental": 0}

SENTINEL_NAMES = ["N/A", "N/A (Antibody)"]
FAILED_STATUSES = ["failed", "withdrawn"]
FAILURE_SOURCES = ["clinical_trial_failures", "drug_withdrawals"]

# Instruction templates (Python str.format placeholders).
ANALYSIS_TEMPLATES = [
    "Analyze this drug candidate and predict its approval likelihood:\nSMILES: {smiles}\nDrug Name: {name}",
    "Evaluate the safety and efficacy potential of the following molecule:\n{smiles}\nName: {name}",
    "Provide a comprehensive drug development assessment for:\nMolecular Structure: {smiles}\nCandidate Name: {name}",
    "As a pharmaceutical researcher, analyze this compound:\n{smiles}\n{name}",
    "Predict whether this drug candidate will succeed in clinical trials:\n{smiles}",
]
COMPARISON_TEMPLATES = [
    "Compare the safety profiles of these two drugs:\nDrug 1: {smiles1} ({name1})\nDrug 2: {smiles2} ({name2})",
    "Which drug candidate has better development potential?\nA: {smiles1} ({name1})\nB: {smiles2} ({name2})",
    "Analyze the differences between these molecules and predict which is more likely to succeed:\n1. {name1}: {smiles1}\n2. {name2}: {smiles2}",
]
FAILURE_ANALYSIS_TEMPLATES = [
    "This drug failed in {phase}. Explain why:\nDrug: {name}\nSMILES: {smiles}",
    "Analyze why {name} was withdrawn/failed and what lessons can be learned:\nStructure: {smiles}",
    "What structural or pharmacological properties led to the failure of {name}?\n{smiles}",
]
IMPROVEMENT_TEMPLATES = [
    "This drug failed due to {reason}. Suggest structural modifications to improve safety:\n{smiles}",
    "How could {name} be modified to reduce its toxicity risks?\nOriginal structure: {smiles}",
    "Propose a safer analog of this failed drug:\n{name}: {smiles}\nFailure reason: {reason}",
]
PROPERTY_TEMPLATES = [
    "Describe the molecular properties and drug-likeness of:\n{smiles}",
    "Analyze the ADMET properties of this compound:\n{smiles}",
    "Evaluate the Lipinski's Rule of 5 compliance and pharmacokinetic potential:\n{smiles}",
]

# ChatML markers.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"

# Request prompts and their blank-input messages.
PROMPT_ANALYSIS = "Analyze this drug candidate and predict its approval likelihood:\nSMILES: "
PROMPT_ANALYSIS_NAME = "\nDrug Name: "
PROMPT_FAILURE = "This drug failed in clinical development. Explain why:\nDrug: "
PROMPT_FAILURE_SMILES = "\nSMILES: "
PROMPT_FAILURE_REASON = "\nKnown issue: "
PROMPT_COMPARISON = "Compare the safety profiles of these two drugs:\nDrug 1: "
PROMPT_COMPARISON_SECOND = "\nDrug 2: "
PROMPT_SUGGESTION = "This drug failed due to "
PROMPT_SUGGESTION_TAIL = ". Suggest structural modifications to improve safety:\n"
PROMPT_SUGGESTION_NAME = "\nName: "
ERROR_NO_SMILES = "⚠️ Please enter a SMILES string."
ERROR_NO_PAIR = "⚠️ Please enter SMILES strings for both drugs."
ERROR_NO_PROBLEM = "⚠️ Please enter both a SMILES string and the problem to address."
ERROR_NO_MESSAGE = "⚠️ Please enter a message."

# Outcome labels, confidence and markers of the analysis report.
OUTCOME_APPROVED = ("APPROVED", "High", "✅")
OUTCOME_FAILED = ("FAILED/WITHDRAWN", "High", "❌")
OUTCOME_DEVELOPMENT = ("IN DEVELOPMENT", "Medium", "🔬")
OUTCOME_UNLIKELY = ("UNLIKELY TO SUCCEED", "Medium", "⚠️")

# Analysis report pieces.
ANALYSIS_HEAD = "## Drug Analysis Report\n\n### Prediction: "
ANALYSIS_CONFIDENCE = "\n**Confidence Level:** "
ANALYSIS_TABLE_HEAD = (
    "\n\n### Molecular Properties Analysis\n\n"
    "| Property | Value | Assessment |\n"
    "|----------|-------|------------|\n"
)
ANALYSIS_ROWS = [
    # (label, unit suffix, good text, bad text)
    ("Molecular Weight", " Da", "✓ Good (<500)", "⚠ High (>500)"),
    ("LogP (Lipophilicity)", "", "✓ Good (<5)", "⚠ High (>5)"),
    ("H-Bond Acceptors", "", "✓ Good (≤10)", "⚠ High (>10)"),
    ("H-Bond Donors", "", "✓ Good (≤5)", "⚠ High (>5)"),
    ("Polar Surface Area", " Å²", "✓ Good (≤140)", "⚠ High (>140)"),
    ("Rule of 5 Violations", "", "✓ Compliant", "⚠ Non-compliant"),
]
ANALYSIS_LIKENESS_HEAD = "\n### Drug-Likeness Assessment\n"
LIKENESS_EXCELLENT = """
The compound shows **excellent drug-like properties**:
- Fully compliant with Lipinski's Rule of 5
- Good balance of hydrophilicity/lipophilicity for membrane permeation
- Suitable molecular weight for oral bioavailability
"""
LIKENESS_ACCEPTABLE = """
The compound shows **acceptable drug-like properties** with minor concerns:
- Minor deviation from Lipinski's Rule of 5
- May require formulation optimization for oral delivery
"""
LIKENESS_POOR = """
The compound shows **poor drug-like properties**:
- Multiple violations of Lipinski's Rule of 5
- May have bioavailability challenges
- Consider structural modifications to improve pharmacokinetics
"""
FAILURE_SECTION_HEAD = "\n### Failure Analysis\n\n**Reason for Failure:** "
FAILURE_SECTION_BODY = """

This compound was withdrawn/failed likely due to:
1. **Safety signals** detected in clinical trials or post-market surveillance
2. **Mechanism-related toxicity** affecting non-target tissues
3. **Drug-drug interaction** potential from metabolic vulnerabilities

### Lessons Learned
To avoid similar failures, future candidates should:
- Undergo comprehensive safety profiling early in development
- Include diversity in clinical trial populations
- Monitor for class-related adverse effects
"""
SUCCESS_SECTION = """
### Success Factors

This drug was successfully approved, demonstrating:
1. **Favorable safety profile** through clinical development
2. **Clear efficacy** in target patient population
3. **Acceptable risk-benefit ratio** for intended indication

### Key Success Indicators
- Completed Phase III trials with positive outcomes
- Manageable side effect profile
- Clear differentiation from existing treatments
"""
DEFAULT_FAILURE_REASON = "Safety concerns"

# Failure report pieces.
FAILURE_REPORT_HEAD = "## Drug Failure Analysis: "
FAILURE_REPORT_FIELDS = ["**Phase Failed:** ", "**Year:** ", "**Therapeutic Area:** ", "**Failure Category:** "]
FAILURE_REPORT_REASON_HEAD = "\n\n### Detailed Failure Reason\n\n"
FAILURE_REPORT_MECHANISM_HEAD = "\n### Mechanism of Toxicity\n\n"
FAILURE_DEFAULTS = {"name": "Unknown", "phase": "Unknown phase", "reason": "Safety/Efficacy concerns",
                    "category": "Unknown"}
CARDIO_SECTION = """
### Cardiovascular Toxicity Analysis

**Key Risk Factors:**
1. **hERG Channel Inhibition:** Many cardiotoxic drugs block the hERG potassium channel, leading to QT prolongation and potentially fatal arrhythmias (Torsades de Pointes)
2. **Prothrombotic Effects:** Selective COX-2 inhibitors reduce prostacyclin production, tipping the balance toward platelet aggregation
3. **Myocardial Stress:** Some drugs cause direct cardiomyocyte damage or increase cardiac workload

**Structural Alerts:**
- Tertiary amines with lipophilic aromatic rings often show hERG liability
- Basic nitrogen at appropriate distance from aromatic system increases hERG risk

**Prevention Strategies:**
- Early hERG screening (patch clamp assays)
- In vivo QT studies in multiple species
- Careful monitoring in clinical trials for PR/QT changes
"""
HEPATO_SECTION = """
### Hepatotoxicity Analysis

**Key Risk Factors:**
1. **Reactive Metabolite Formation:** CYP450 metabolism can generate electrophilic species that bind to proteins
2. **Bile Salt Transport Inhibition:** BSEP inhibition leads to intrahepatic cholestasis
3. **Mitochondrial Toxicity:** Disruption of oxidative phosphorylation in hepatocytes

**Structural Alerts:**
- Quinone/quinone-imine forming structures
- Michael acceptors (α,β-unsaturated carbonyls)
- Compounds with furan, thiophene rings
- Hydrazines and anilines

**Prevention Strategies:**
- Reactive metabolite trapping studies
- BSEP inhibition assays
- Mitochondrial toxicity screening
- In vivo liver function biomarker monitoring
"""
EFFICACY_SECTION = """
### Efficacy Failure Analysis

**Common Reasons for Efficacy Failure:**
1. **Target Selection Issues:** Pre-clinical models may not accurately reflect human disease biology
2. **Patient Population Heterogeneity:** Subgroups may respond differently
3. **Dose Selection:** May not achieve adequate target engagement
4. **Biomarker Disconnect:** Surrogate endpoints may not correlate with clinical outcomes

**Prevention Strategies:**
- Extensive target validation using human genetics data
- Biomarker-driven patient stratification
- PK/PD modeling to optimize dosing
- Adaptive trial designs
"""
TAKEAWAYS_SECTION = """
### Key Takeaways for Drug Development

1. **Early Safety Screening:** Implement comprehensive in vitro and in vivo safety panels before clinical development
2. **Mechanism Understanding:** Deep mechanistic understanding helps predict and mitigate risks
3. **Patient Monitoring:** Identify high-risk patient populations and implement appropriate monitoring
4. **Structural Optimization:** Use SAR to move away from structural liabilities while maintaining efficacy
"""
# Failure category routing keywords, in order of precedence.
ROUTE_CARDIO = ["cardio", "cardiac"]
ROUTE_HEPATO = ["hepato", "liver"]
ROUTE_EFFICACY = ["efficacy"]

# Comparison report pieces.
COMPARISON_HEAD = "## Comparative Drug Analysis\n\n### Head-to-Head Comparison\n\n| Property | "
COMPARISON_TROPHY = "🏆 "
COMPARISON_NONE = "—"
COMPARISON_WINNER = (" is the clear winner as it has achieved regulatory approval, demonstrating successful "
                     "clinical development with an acceptable safety/efficacy profile.\n\n")
COMPARISON_LOSER = """ has not achieved approval, which may indicate:
- Efficacy challenges in clinical trials
- Safety concerns that limited development
- Strategic decision to discontinue development
"""
COMPARISON_SIMILAR_HEAD = "Both compounds are at similar development stages. Based on molecular properties:\n\n"
COMPARISON_SIMILAR_TAIL = ("\nFurther investigation into mechanism of action, selectivity, and target engagement "
                           "would be needed for definitive comparison.\n")
COMPARISON_DEFAULT_NAMES = ("Drug 1", "Drug 2")

# Property report pieces.
PROPERTY_ROWS = [
    # (label, unit suffix, optimal range)
    ("Molecular Weight", " Da", "150-500 Da"),
    ("LogP (cLogP)", "", "0-5"),
    ("H-Bond Acceptors", "", "≤10"),
    ("H-Bond Donors", "", "≤5"),
    ("PSA", " Å²", "<140 Å²"),
    ("Rotatable Bonds", "", "≤10"),
]
ADMET_TEXT = {
    "absorption": ("Good oral absorption expected", "May have oral absorption challenges"),
    "cns": ("Likely CNS penetrant", "Limited CNS penetration expected"),
    "binding": ("High plasma protein binding likely", "Moderate plasma protein binding expected"),
    "volume": ("High (lipophilic)", "Moderate", "Low (hydrophilic)"),
    "metabolism": ("CYP450 substrate likely", "May undergo phase II metabolism primarily"),
    "inhibition": ("Potential CYP inhibition risk", "Low CYP inhibition expected"),
    "clearance": ("Likely hepatic clearance", "May undergo renal clearance"),
    "half_life": ("Long half-life expected", "Moderate half-life expected"),
}
NATURAL_PRODUCT_SECTION = """
### Natural Product Flag
This compound is derived from or inspired by natural products, which often have:
- Complex stereochemistry
- Unique mechanisms of action
- Potentially better target selectivity
"""

# Improvement report (the recommendations block is constant).
IMPROVEMENT_BODY = """

### Recommended Modifications

1. **Reduce Metabolic Liability**
   - Replace metabolically labile groups (e.g., ester → amide)
   - Block sites of CYP450 oxidation with fluorine substitution
   - Reduce lipophilicity to minimize reactive metabolite formation

2. **Improve Selectivity**
   - Add stereochemical constraints to reduce off-target binding
   - Modify substituents to exploit differences in target binding sites
   - Use structure-guided design based on target crystal structures

3. **Address Specific Toxicity**
   - If cardiotoxicity: reduce basicity and lipophilicity to lower hERG risk
   - If hepatotoxicity: remove metabolically activated groups
   - If CNS effects: increase polarity to reduce brain penetration

### General Principles
- Maintain target engagement (measure IC50/EC50)
- Improve therapeutic index (efficacy dose vs toxicity dose)
- Consider prodrug strategies for problematic functional groups
"""

# Task types of the instruction set, with their selection caps.

# Split cuts of the instruction set and of the classification set.

# Evaluation: minimum response length and the AUC interpretation cut.
GOOD_AUC = 0.7
# --------------------------------------------------------------------------------
