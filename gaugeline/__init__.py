"""Gaugeline: a Spark-native engine for auditable market-signal reports."""
