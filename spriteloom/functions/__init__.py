"""Column expressions and per-image numpy kernels."""
