"""Streaming of millrace."""
