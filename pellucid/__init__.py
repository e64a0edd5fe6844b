"""Data-quality checks, profiles and drift for property graphs held as Spark tables."""
