"""Operators for preparing training corpora: near-duplicates, filtering, extraction, mixing, archiving."""
