"""Plans of the city-model engine."""
