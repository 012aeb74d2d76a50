"""Sources of chunks: seven transcript stores and the driver tables."""
