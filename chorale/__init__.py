"""Spark-native analytics over ensembles of machine transcripts."""
