"""The shared job predicate and what is planned over it."""
