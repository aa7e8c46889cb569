"""Column builders: volume-delay functions, geography, time of day, deterrence."""
