"""Operators of millrace."""
