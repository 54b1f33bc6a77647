"""Relational operators: contracts, QC, cohort, labels, windows, sequences, splits, evaluation, models."""
