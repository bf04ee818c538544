"""Whole queries."""
