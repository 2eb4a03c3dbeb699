"""Operators for preparing training data, each by one named method, on whole tables."""
