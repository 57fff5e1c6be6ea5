"""Renderers and stores of results."""
