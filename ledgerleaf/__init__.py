"""Spark jobs for report text, catalogues and corpus preparation."""
