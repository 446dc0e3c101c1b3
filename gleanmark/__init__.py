"""Evaluation of structured information extraction as Spark DataFrame operators."""
