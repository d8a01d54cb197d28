"""DataFrame operators: flatten, map, validate, catalogue, filter, join, aggregate."""
