"""functions of quarrymill."""
