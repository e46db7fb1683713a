"""PySpark-native retrieval and library-analytics engine."""
