"""Sources of millrace."""
