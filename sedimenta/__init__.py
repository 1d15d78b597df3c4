"""Ordered key/value tables on Spark: versioned Parquet runs, merged at read time."""
