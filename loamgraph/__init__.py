"""A PySpark-native engine for document archives: retrieval, graph, evidence and review."""
