"""streaming of the isomere engine."""
