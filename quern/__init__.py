"""Spark-native queries over keyed tables."""
