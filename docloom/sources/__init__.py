"""Durable collections and databases."""
