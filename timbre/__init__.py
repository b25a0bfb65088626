"""Spark-native evaluation analytics for speech-generation experiments."""
