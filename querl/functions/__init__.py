"""Types of the dialect and column functions where its meaning differs from Spark's."""
