"""Operators: DataFrame in, DataFrame (or a pyspark.ml model) out."""
