"""Live histories."""
