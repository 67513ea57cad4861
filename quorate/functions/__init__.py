"""Column expressions and bounded numeric kernels."""
