"""Text-safety and code-review analytics on Spark."""
