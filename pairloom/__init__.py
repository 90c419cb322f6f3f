"""Spark-native analytics over paired-replicate contact maps and interval annotations."""
