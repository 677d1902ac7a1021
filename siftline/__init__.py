"""A PySpark engine for plan-driven extraction and analytics over captured pages and tables."""
