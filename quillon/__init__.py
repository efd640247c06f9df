"""Document-query analytics on Spark."""
