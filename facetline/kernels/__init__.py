"""Sequential kernels: Python and numpy, no Spark, shared by batch and streaming."""
