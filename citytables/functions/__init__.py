"""Functions of the city-model engine."""
