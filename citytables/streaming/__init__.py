"""Streaming of the city-model engine."""
