"""Operators for preparing training data: search, tokenising, archives, privacy, de-duplication, mixing."""
