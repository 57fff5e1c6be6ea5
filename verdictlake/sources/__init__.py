"""Readers of experiment records."""
