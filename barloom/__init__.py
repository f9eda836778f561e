"""barloom: a Spark-first library for training-knowledge data: ingestion, retrieval, analytics and planning rules."""
