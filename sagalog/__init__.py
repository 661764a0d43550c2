"""A Spark-native typed message log and document analytics engine."""
