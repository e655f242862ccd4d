"""operators of the isomere engine."""
