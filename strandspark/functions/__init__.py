"""Column functions: activations, distributions, array operators, quality scores."""
