"""CSV, snapshots and the catalog."""
