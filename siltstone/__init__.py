"""Selective-scan analytics on Spark: compact filter and aggregate languages compiled to DataFrame plans."""
