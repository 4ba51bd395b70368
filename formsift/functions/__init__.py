"""Column expressions. Every function takes and returns a Column; none uses Python per row."""
