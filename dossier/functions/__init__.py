"""Column functions: everything here is a Catalyst expression or a small Arrow helper."""
