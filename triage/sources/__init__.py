"""Reading and writing of stored tables."""
