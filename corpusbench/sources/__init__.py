"""sources of the corpusbench package."""
