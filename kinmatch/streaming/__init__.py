"""streaming of kinmatch."""
