"""Genome and gene-model analytics as PySpark DataFrame operators."""
