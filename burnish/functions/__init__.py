"""Column functions: text, scalar parsing and display profiles.  All native expressions."""
