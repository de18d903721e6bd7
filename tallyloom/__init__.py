"""PySpark-native engine for curating and evaluating preference data and training corpora."""
