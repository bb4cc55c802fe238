"""Column -> Column functions: molecule checks, rule columns, text and array helpers."""
