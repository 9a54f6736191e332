"""Reading text tables and writing results."""
