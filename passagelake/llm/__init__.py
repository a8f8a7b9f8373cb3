"""Operators for preparing training data, their queries and their SQL; nothing else in the library imports this."""
