"""Order-book replay on Spark."""
