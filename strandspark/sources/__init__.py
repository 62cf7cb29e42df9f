"""Readers and writers of reads, run records, matrices and sequence files."""
