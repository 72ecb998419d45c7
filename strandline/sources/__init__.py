"""Readers and writers for genomic file formats."""
