"""Terrafold: Spark-native analytics over fragment collections."""
