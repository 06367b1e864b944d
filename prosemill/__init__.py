"""prosemill: Spark-first text-signal analytics."""
