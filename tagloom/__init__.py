"""Tag-aware catalog matching, ranking and analytics on Spark."""
