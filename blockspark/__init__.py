"""blockspark: community structure in large weighted graphs, and tuning of the partitioner, on Spark."""
