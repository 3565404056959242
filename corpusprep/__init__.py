"""Preparing and checking language-model training data on Spark."""
