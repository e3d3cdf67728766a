"""Operators of a training-data pipeline: packing, near-duplicate and passage
removal, decontamination, filters, scans, scoring, search and chat formatting."""
