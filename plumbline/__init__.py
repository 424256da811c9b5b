"""Evaluation analytics for open-set classifiers, as PySpark DataFrame jobs."""
