"""Operators: DataFrame in, DataFrame out, whole tables."""
