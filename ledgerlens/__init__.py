"""Customer feature and classification engine on Spark."""
