"""larkspur: a Spark-first engine over a typed document-memory corpus."""
