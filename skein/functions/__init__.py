"""Scalar functions as column expressions; none runs Python on the executors unless it says so."""
