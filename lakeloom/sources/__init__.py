"""Sources, sinks and storage."""
