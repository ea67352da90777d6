"""Panel analytics on Spark: leakage-safe features, interval scoring, policies and their evaluation."""
