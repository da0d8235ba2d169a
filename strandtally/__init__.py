"""Spark engine for summarising sequencing-alignment files and cleaning text corpora."""
