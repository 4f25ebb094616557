"""Text-graph analytics on PySpark: hybrid retrieval, graph walks, incremental tables and corpus statistics."""
