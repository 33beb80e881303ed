"""operators of the brandsieve package."""
