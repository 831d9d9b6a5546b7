"""Whole reports: parameterised compositions of the operators."""
