"""Rule-evidence analytics over graphs, written as Spark DataFrame queries."""
