"""Column helpers and numeric kernels."""
