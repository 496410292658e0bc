"""Composed plans and join strategies."""
