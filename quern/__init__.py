"""quern: Spark-native retrieval, evaluation and curation analytics."""
