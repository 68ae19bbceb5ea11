"""Spark-native operators for time-coded text, interval sets and edit plans."""
