"""Operators for preparing large text corpora: near-duplicates, tokens, extraction, filtering and mixing."""
