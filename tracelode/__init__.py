"""Spark-native analysis of digital evidence: extract, validate, enrich, link."""
