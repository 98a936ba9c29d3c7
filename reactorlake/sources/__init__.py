"""Sources and sinks: landed pages, base tables, snapshots, state, test-table adapter."""
