"""Full-text search and retrieval analytics on Spark."""
