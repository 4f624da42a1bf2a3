"""Progress streams."""
