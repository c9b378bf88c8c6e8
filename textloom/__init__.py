"""A Spark-native engine from document corpora to queryable knowledge graphs."""
