"""Spark-native page extraction and data cleaning."""
