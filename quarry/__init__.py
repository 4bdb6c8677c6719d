"""A Spark-native engine for indexing and searching a video library's notes, chunks and frames."""
