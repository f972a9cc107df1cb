"""The same reports over answers and logs that keep arriving."""
