"""tidemark: point-in-time event analytics as PySpark DataFrame operators."""
