"""Documents and graph formats."""
