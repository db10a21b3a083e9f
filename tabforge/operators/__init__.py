"""Relational operators: profiling, binning, drift, transforms, selection, sampling, scoring and evaluation."""
