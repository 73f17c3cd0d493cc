"""Compositions: feature build, training, scoring, comparison."""
