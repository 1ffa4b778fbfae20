"""textloom: a PySpark-native engine for curating, pairing and scoring text corpora."""
