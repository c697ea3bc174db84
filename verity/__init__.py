"""verity: a Spark-first engine for auditing labels in large flat tables."""
