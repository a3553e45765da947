"""Analytics over labelled event data on Spark: hygiene, partitioning, fusion, federation, control and audit."""
