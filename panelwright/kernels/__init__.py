"""NumPy kernels of the models: vectors in, results out, no Spark."""
