"""Scalar column functions: numbers, dates, option pricing, text."""
