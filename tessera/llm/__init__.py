"""Training-data pipeline operators (optional subpackage; nothing else in the library imports it)."""
