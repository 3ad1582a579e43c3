"""quarry: a PySpark-native analytics engine for dialogue evaluation and training corpora."""
