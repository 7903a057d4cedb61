"""Column expressions and small vectorised kernels."""
