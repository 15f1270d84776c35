"""operators of kinmatch."""
