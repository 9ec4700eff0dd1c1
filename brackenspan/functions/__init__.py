"""Column functions: normal forms, predicates, text positions, geography."""
