"""Scoring, validation and search over tables of facility and route plans."""
