"""Writers and the tables they write."""
