"""Reading files and records, and writing results."""
