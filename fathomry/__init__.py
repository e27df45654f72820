"""fathomry: a PySpark-native retrieval, indexing and corpus engine."""
