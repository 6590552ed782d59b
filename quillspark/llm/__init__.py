"""Operators for building training corpora: mixing, token output, language
identification, deduplication, decontamination, quality rules, web archives,
URL filters and secret scans.  Nothing else in the library imports this."""
