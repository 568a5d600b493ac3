"""Analytical views and named questions over the price survey model."""
