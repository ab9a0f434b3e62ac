"""embertrace: a PySpark-native engine for chat, annotation and document analytics."""
