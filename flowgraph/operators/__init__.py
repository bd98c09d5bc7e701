"""DataFrame operators: projection, traversal, registry, integrity, display."""
