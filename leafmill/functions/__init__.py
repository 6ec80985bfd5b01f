"""Column functions: all of them expressions that Catalyst sees through."""
