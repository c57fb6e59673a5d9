"""Spark-native enrichment and analysis of semi-structured documents."""
