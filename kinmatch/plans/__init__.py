"""plans of kinmatch."""
