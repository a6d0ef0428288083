"""Spatial-omics analytics on Spark."""
