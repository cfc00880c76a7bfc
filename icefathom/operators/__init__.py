"""Whole-table operators, DataFrame in and DataFrame out."""
