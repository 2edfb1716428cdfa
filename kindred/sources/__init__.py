"""Sources and sinks: tab-separated records, truth, pools, snapshots, pair and feature files."""
