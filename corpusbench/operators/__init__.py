"""operators of the corpusbench package."""
