"""Operators that prepare candidate texts, job texts and vectors for training language models."""
