"""Sequence, interval and count-matrix analytics on Apache Spark."""
