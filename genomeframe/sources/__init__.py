"""Readers for FASTA, GFF3, BED and model tables."""
