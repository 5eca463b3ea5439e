"""Populations of expression trees over tables: fitting, scoring and comparing them on Spark."""
