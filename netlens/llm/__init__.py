"""Operators of a training-data pipeline: ten stages over tables of documents and pages."""
