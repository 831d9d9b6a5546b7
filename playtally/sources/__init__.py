"""Table schemas, readers, and the CSV sink."""
