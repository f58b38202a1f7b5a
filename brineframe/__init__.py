"""Gridded ocean-profile analytics as Spark DataFrame operators."""
