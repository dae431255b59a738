"""vellumflow: a Spark-native analytics engine for annotated historical text."""
