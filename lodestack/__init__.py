"""Spark-native snapshot, retrieval, structure, ledger and call-journal engine."""
