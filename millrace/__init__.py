"""millrace: a PySpark-native engine for operational and document analytics."""
