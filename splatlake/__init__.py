"""A PySpark-native engine for 3-D Gaussian-splat point sets and training-text corpora."""

__version__ = "0.1.0"
