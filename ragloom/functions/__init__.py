"""Column functions: they build expressions and start no job."""
