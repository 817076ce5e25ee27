"""Estimator fits on Spark ML: distributed fit and transform."""
