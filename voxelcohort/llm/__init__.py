"""Operators for building training corpora: quality, similarity, privacy, toxicity, extraction, search and encoding."""
