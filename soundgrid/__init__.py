"""Gridded-depth analytics expressed as Spark DataFrame queries."""
