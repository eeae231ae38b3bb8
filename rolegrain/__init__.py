"""rolegrain: vacancy-catalog analytics written as Spark DataFrame and SQL functions."""
