"""attestry: Spark-native evaluation and annotation analytics for retrieval-augmented generation."""
