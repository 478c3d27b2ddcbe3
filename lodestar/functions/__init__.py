"""Column functions: predicates, names, locations, text and command lines."""
