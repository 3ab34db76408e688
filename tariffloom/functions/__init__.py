"""Scalar functions as Column -> Column; all run inside Spark's generated code or its built-in higher-order functions."""
