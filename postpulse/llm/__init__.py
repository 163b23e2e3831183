"""Corpus-preparation operators for training data.

Workers import this package by name, so it has to be importable on the
executors (installed there, or on their ``PYTHONPATH``).
"""
