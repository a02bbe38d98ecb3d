"""Spark-native resolution of form fields from extracted document content."""
