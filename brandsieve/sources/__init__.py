"""sources of the brandsieve package."""
