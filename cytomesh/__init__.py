"""Spatial cell analytics expressed as Spark DataFrame jobs."""
