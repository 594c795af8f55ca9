"""Spark-native analytics for electric-vehicle telemetry."""
