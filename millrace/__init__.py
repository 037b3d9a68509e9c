"""Record-linkage analytics on Spark."""
