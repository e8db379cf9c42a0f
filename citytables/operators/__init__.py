"""Operators of the city-model engine."""
