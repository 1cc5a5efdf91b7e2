"""Provenix: media-provenance analytics on PySpark DataFrames."""
