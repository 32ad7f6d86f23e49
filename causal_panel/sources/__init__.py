"""Reading drifting multi-epoch files and writing snapshots and reports."""
