"""Document-corpus retrieval and analytics as Spark DataFrame operators."""
