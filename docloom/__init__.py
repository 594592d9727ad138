"""Document preparation on Spark: scan, clean, redact, chunk, re-scan and write."""
