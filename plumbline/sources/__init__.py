"""Table access: scans, versioned tables, feed mappings, and the adapter frames over the test tables."""
