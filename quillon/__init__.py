"""Spark-native digests: profile, search, rank, roll up, resolve, traverse, compare, extract, budget."""
