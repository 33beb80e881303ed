"""streaming of the brandsieve package."""
