"""plans of the brandsieve package."""
