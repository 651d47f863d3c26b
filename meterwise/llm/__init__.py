"""Training-data pipeline operators (nothing else in the library imports this package)."""
