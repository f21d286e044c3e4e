"""Column expressions: every function here maps columns to columns and adds no shuffle."""
