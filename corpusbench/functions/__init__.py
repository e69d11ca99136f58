"""functions of the corpusbench package."""
