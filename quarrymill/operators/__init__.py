"""operators of quarrymill."""
