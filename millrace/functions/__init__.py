"""Functions of millrace."""
