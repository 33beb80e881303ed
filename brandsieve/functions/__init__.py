"""functions of the brandsieve package."""
