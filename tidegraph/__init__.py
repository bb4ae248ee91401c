"""Spark-native analytics for networks whose edges fail at random."""
