"""Operators: DataFrame in, DataFrame out, thresholds as arguments."""
