"""Near-duplicate pair engine on Spark."""
