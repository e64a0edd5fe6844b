"""Where graphs, suites and snapshots come from."""
