"""Vector scalar functions: Column expressions and the NumPy kernels behind Arrow operators."""
