"""Spark-first analytics over tables of described projects and their text corpus."""

__version__ = "0.1.0"
