"""Portfolio-risk analytics as Spark DataFrame transformations."""
