"""functions of kinmatch."""
