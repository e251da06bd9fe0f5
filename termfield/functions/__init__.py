"""Column functions: association measures and transformations."""
