"""Operators for preparing training data; nothing else in relstore imports them."""
