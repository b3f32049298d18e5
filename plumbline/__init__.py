"""Governed metrics as Spark DataFrame jobs: products, contracts, policies, drift, lineage, verdicts, recall."""
