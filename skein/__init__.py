"""skein: a PySpark-native transcript retrieval and analytics engine."""
