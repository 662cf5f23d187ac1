"""Wide, high-cardinality service metrics on Spark."""
