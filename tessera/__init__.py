"""Tessera: a PySpark-native engine for evidence analytics and corpus preparation."""
