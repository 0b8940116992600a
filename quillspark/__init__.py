"""Spark-native analytics over recognised documents: layout, decoding, correction, extraction, redaction, metrics, export."""
