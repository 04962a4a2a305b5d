"""Data-contract and release-gate checks as Spark DataFrame jobs."""
