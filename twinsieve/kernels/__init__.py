"""Image kernels on numpy arrays, and their Spark wrappers."""
