"""Operators for large training-text corpora.  Nothing else in docloom imports this package."""
