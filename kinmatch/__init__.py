"""kinmatch: record linkage as DataFrame plans."""
