"""Brookloom: a PySpark-native engine for mentoring-corpus analytics and training-data preparation."""
