"""loomquery: retrieval analytics and training-data preparation as PySpark DataFrame programs."""
