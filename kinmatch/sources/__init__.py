"""sources of kinmatch."""
