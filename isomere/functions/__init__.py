"""functions of the isomere engine."""
