"""Relational operators: history windows, ratings, pairing, metrics, audits."""
