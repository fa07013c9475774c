"""Content-stream analytics on Spark: clean, classify, deduplicate, rank and monitor news items."""
