"""Spark-native code-fact analytics: scan, resolve, relate, rank and diff facts as DataFrames."""
