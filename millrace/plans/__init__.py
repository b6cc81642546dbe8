"""Plans of millrace."""
