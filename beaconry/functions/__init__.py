"""Column functions: predicates, scalars, ordered series and exact quantiles."""
