"""Operators over populations, points and the records of runs."""
