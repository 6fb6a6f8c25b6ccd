"""Operators for the preparation of training text; nothing outside this folder imports it."""
