"""Results as pulled rows."""
