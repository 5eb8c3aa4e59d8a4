"""Whole runs made of operators."""
