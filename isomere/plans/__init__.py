"""plans of the isomere engine."""
