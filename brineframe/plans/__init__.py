"""Named queries: how the operators compose on the driver's tables."""
