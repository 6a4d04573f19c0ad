"""Extraction and exploration of play logs as Spark DataFrame plans."""
