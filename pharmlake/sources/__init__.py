"""Sources: landed files (CSV, JSON, JSONL), nested record flattening, and the
table bindings that give the driver's parquet tables the reference's column names."""
