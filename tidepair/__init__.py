"""Paired-transition analytics as Spark DataFrame operators."""
