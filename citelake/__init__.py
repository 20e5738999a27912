"""Citelake: a Spark-native engine for document evidence (ingest, retrieval, evidence shaping, evaluation)."""
