"""contracts of the corpusbench package."""
