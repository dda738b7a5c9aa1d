"""Corpus operators: deduplication, fingerprints, extraction, scans, token files and packing."""
