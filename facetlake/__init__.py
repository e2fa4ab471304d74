"""Faceted document analytics as Spark DataFrame plans."""
