"""Spark-native analytics over multi-channel, scan-ordered instrument traces."""
