"""streaming of the corpusbench package."""
