"""Spark DataFrame operators for building energy-certificate registers."""
