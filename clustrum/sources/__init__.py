"""Readers and writers: dense and sparse vectors, text lines, FASTA, cost files."""
