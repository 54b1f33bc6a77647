"""Operators for preparing training data: search, scans, language, tokens, extraction, duplicates, mixing."""
