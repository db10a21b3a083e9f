"""tabforge: Spark-first profiling, binning, transformation, training and evaluation of tabular data."""

__version__ = "0.1.0"
