"""Spark-native engine for turning study material into structured, checked manuals."""
