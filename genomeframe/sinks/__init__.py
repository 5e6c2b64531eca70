"""Writers for GFF3, bedGraph, FASTA, metrics and model tables."""
