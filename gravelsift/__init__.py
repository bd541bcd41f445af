"""Spark-native moderation and text analytics: every operator takes and returns DataFrames."""
