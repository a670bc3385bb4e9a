"""Whole screens and reports about them."""
