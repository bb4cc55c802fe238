"""End-to-end jobs: molecules to splits (E1), compounds to instruction text (E2),
predictions and responses to metrics (E3)."""
