"""Column functions: trading clock, rolling kernels, scalars."""
