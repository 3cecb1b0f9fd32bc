"""Spatial-transcriptomics analytics as PySpark DataFrame plans."""
