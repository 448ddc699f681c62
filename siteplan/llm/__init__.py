"""Operators that prepare the text of planning records (case prompts, source pages) as training data."""
