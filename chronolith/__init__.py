"""chronolith: a PySpark-native engine for questions about software history."""
