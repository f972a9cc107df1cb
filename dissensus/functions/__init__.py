"""Column functions: every one maps columns to a column, none uses Python per row."""
