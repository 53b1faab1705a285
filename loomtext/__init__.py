"""loomtext: a Spark-native text analytics engine."""
