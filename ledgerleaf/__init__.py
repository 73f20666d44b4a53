"""A PySpark engine for listings of published documents: inventory, duplicates, audit, reports."""
