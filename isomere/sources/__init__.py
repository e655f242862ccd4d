"""sources of the isomere engine."""
