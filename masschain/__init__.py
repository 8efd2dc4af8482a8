"""Spark-native composition analytics: part-of mass facts, roll-ups, uncertainty and served views."""
