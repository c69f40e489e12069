"""Spark-native analytics for genotype, vector, graph, telemetry and text tables."""
