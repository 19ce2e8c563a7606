"""clauseloom: Spark-native analytics for long, regulated text corpora."""
