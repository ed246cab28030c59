"""PySpark-native analytics for erasure-coded storage clusters and training corpora."""
