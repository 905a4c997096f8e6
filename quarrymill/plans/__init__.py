"""plans of quarrymill."""
