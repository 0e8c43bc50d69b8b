"""Text-alignment analytics on Spark: composable DataFrame operators and named queries."""
