"""Spark-first analytics engine for building, scoring and comparing error detectors."""
