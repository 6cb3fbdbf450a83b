"""Rule sets and queries over the driver's tables."""
