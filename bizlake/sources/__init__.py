"""Reading and writing the files the domains exchange."""
