"""sources of quarrymill."""
