"""Spark-native text and code reduction analytics."""
