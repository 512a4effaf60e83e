"""pressloom: evidence retrieval and archive analytics as Spark DataFrame operators."""
