"""Spark-native analytics over weighted bipartite data."""
