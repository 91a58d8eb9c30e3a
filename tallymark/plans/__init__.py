"""Compositions that produce the evidence of one processing step."""
